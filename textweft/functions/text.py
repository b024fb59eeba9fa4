"""Text normalisation as column expressions: one token space for LaTeX, PDF and plain text.

Every function maps a string column to a string column inside the JVM and
returns null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter names after a backslash, and the letters they stand for.
GREEK_NAMES = (
    "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu",
    "nu", "xi", "pi", "rho", "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega",
    "Gamma", "Delta", "Theta", "Lambda", "Xi", "Pi", "Sigma", "Upsilon", "Phi", "Psi", "Omega",
)
GREEK_LETTERS = "αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΥΦΨΩ"
# Operators and functions kept by name, replaced group by group, and symbols with their words, replaced one by one.
NAMED_OPERATORS = (("sum", "int", "prod", "lim", "sup", "inf"), ("exp", "log", "ln", "sin", "cos", "tan"))
SYMBOLS = {"hbar": "hbar", "infty": "inf", "partial": "partial", "nabla": "nabla", "times": "times", "cdot": "dot", "pm": "plusminus", "leq": "leq", "geq": "geq", "neq": "neq", "approx": "approx"}
UMLAUTS = {"a": "ä", "o": "ö", "u": "ü", "A": "Ä", "O": "Ö", "U": "Ü"}
# Commands whose argument is kept, in the order they are unwrapped.
UNWRAPPED = (
    "textbf", "textit", "emph", "text", "mathrm", "mathbf", "mathit", "mathcal", "mathbb", "mathsf", "operatorname",
    "title", "author", "section", "subsection", "subsubsection", "paragraph", "caption", "label", "ref", "cite",
)

#: Python's notion of white space (Unicode, and the four separators \x1c-\x1f).
SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; outer ones go."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def in_turn(c: Column, steps: list[tuple[str, str]]) -> Column:
    """Replace the patterns one after the other.

    A fold over a constant array instead of a nest of calls: the expression
    stays small however many steps there are.  It is evaluated row by row and
    not by generated code, and patterns are compiled anew for each row, so
    callers keep rows away that no step would change.
    """
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for p, i in steps])
    return F.aggregate(table, c, lambda text, step: F.regexp_replace(text, step["p"], step["i"]))


def where_any(c: Column, pattern: str, steps: list[tuple[str, str]]) -> Column:
    """:func:`in_turn` where ``pattern``, which every text a step changes must match, is found; ``c`` is evaluated once."""
    return F.element_at(F.transform(F.array(c), lambda v: F.when(v.rlike(pattern), in_turn(v, steps)).otherwise(v)), 1)


#: Name by name: a command directly followed by the word of an earlier name is no command any more.
GREEK_COMMANDS = [(rf"(?U)\\{name}\b", name.lower()) for name in GREEK_NAMES]
GREEK_CHARACTERS = [(letter, name.lower()) for letter, name in zip(GREEK_LETTERS, GREEK_NAMES, strict=True)]
#: Fixed values, like those above: one pass, innermost braces only.
MATHEMATICS = [
    (r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "frac($1,$2)"),
    (r"\\sqrt\{([^{}]*)\}", "sqrt($1)"),
    (r"\^\{([^{}]*)\}", "^($1)"),
    (r"_\{([^{}]*)\}", "_($1)"),
    *[(r"(?U)\\(" + "|".join(group) + r")\b", "$1") for group in NAMED_OPERATORS],
    *[(rf"(?U)\\{name}\b", word) for name, word in SYMBOLS.items()],
    *[(rf'\\"{plain}', dotted) for plain, dotted in UMLAUTS.items()],
]
#: What a text must hold for any of the steps to change it.
GREEK_COMMAND = r"\\(?:" + "|".join(GREEK_NAMES) + ")"
GREEK_CHARACTER = "[" + GREEK_LETTERS + "]"
MATHEMATICAL = r"\\(?:frac|sqrt|\"|" + "|".join([*(name for group in NAMED_OPERATORS for name in group), *SYMBOLS]) + r")|[_^]\{"
#: Commands that are left, and braces, brackets and dollar signs, become spaces.
LEFTOVERS = [(r"\\[a-zA-Z]+\*?(?U:[\s\x1c-\x1f])*", " "), (r"[{}\[\]$]", " ")]


def normalise(c: Column) -> Column:
    """The canonical form compared everywhere: tokens for mathematics, lower case, single spaces.

    Texts without a backslash, a script brace or a Greek letter, which is most
    plain text, take two passes.
    """
    markup = where_any(c, GREEK_COMMAND, GREEK_COMMANDS)
    markup = where_any(markup, GREEK_CHARACTER, GREEK_CHARACTERS)
    markup = where_any(markup, MATHEMATICAL, MATHEMATICS)
    for pattern, into in LEFTOVERS:
        markup = F.regexp_replace(markup, pattern, into)
    greek = in_turn(c, [*GREEK_CHARACTERS, LEFTOVERS[1]])
    marked = F.contains(c, F.lit("\\")) | F.contains(c, F.lit("_{")) | F.contains(c, F.lit("^{"))
    lettered = (F.length(c) < F.octet_length(c)) & c.rlike(GREEK_CHARACTER)
    out = F.when(marked, markup).when(lettered, greek).otherwise(F.regexp_replace(c, *LEFTOVERS[1]))
    return collapse(F.lower(out))


def strip_structure(c: Column) -> Column:
    """LaTeX without comments, preamble, bibliography and environments; text of known commands kept."""
    c = F.regexp_replace(c, r"%[^\n]*", " ")
    steps = [(r"(?s)^.*?\\begin\{document\}", ""), (r"(?is)\\begin\{thebibliography\}.*$", "")]
    steps += [(rf"\\{name}\*?\{{([^{{}}]*)\}}", "$1") for name in UNWRAPPED]
    return F.when(F.contains(c, F.lit("\\")), in_turn(c, [*steps, (r"\\(begin|end)\{[^}]*\}", " ")])).otherwise(c)


def clean_extracted(c: Column) -> Column:
    """Text taken from a page layout: control characters become spaces, white space is collapsed."""
    return collapse(F.regexp_replace(c, r"[\x00-\x1F\x7F-\x9F]", " "))


def cut_references(c: Column, after: float = 0.75) -> Column:
    """Cut at the first word References or Bibliography if it starts beyond that part of the text.

    Only the first such word counts: one earlier keeps the whole text.  Lengths are code points.
    """
    head = F.regexp_extract(c, r"(?isU)^(.*?)\b(?:References|Bibliography)\b", 1)
    found = c.rlike(r"(?iU)\b(?:References|Bibliography)\b")
    return F.when(found & (F.length(head) > F.length(c) * F.lit(after)), head).otherwise(c)


def tokens(c: Column) -> Column:
    """Words of a collapsed text; an empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def last_segment(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def valid_utf8(c: Column) -> Column:
    """Bytes as text, with the replacement character for what is no UTF-8."""
    return F.make_valid_utf8(c.cast("string"))


def first_adequate(*choices: tuple[Column, int]) -> Column:
    """The first text that has at least its number of words; null if none has."""
    return F.coalesce(*[F.when(F.size(tokens(collapse(c))) >= n, c) for c, n in choices])

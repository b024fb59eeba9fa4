"""Fixed inputs for what the test tables do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LATEX = [
    (1, r"\alpha + \beta_1"), (2, r"\frac{a}{b} = \sqrt{c}"), (3, r"\frac{\sqrt{a}}{b}"), (4, r"\sum_{i} x^{2}"), (5, r"\sum x \leq \infty"),
    (6, r"\int_0^{1} f"), (7, "αβ Γ"), (8, r"\alpha\beta"), (9, "α_1"), (10, 'Schr\\"odinger'), (11, '\\"{o}'), (12, r"\varepsilon x"),
    (13, r"\textbf{Hi} there"), (14, "Cost $5 [ref] {x}"), (15, " a  b\n"), (16, ""), (17, r"\hbar \cdot \pm \times \nabla \partial"), (18, r"\exp x \log_2 \Omega\omega"),
]
STRUCTURE = [
    (1, r"50\% of x"), (2, r"\section*{Intro} see \cite{k1}\begin{thebibliography}{9}X"), (3, r"\emph{\textbf{a}}"), (4, r"\textbf{\emph{a}}"),
    (5, "pre\n\\begin{document}body % note\nmore\\end{document}"), (6, r"\BEGIN{x} \Begin{Thebibliography} y"), (7, r"\operatorname{rank}\mathbb{R}\label{l}"), (8, ""),
]
LAYOUT = [(-1, "a " * 20 + "References b c"), (-2, "References " + "a " * 30), (-3, "x\x07y\tz  "), (-4, "word " * 9 + "bibliography z"), (-5, ""), (-6, "preferences " + "q " * 3)]
PRIORITY = [(1, "a b c d e", "p q", "t"), (2, "a b", "p q", "t"), (3, None, None, "t u"), (4, "a b c d", None, None), (5, None, "", "x"), (6, None, None, None)]
MEMBERS = [("a", "main.tex", 10, 1), ("a", "big.TEX", 99, 2), ("a", "second.tex", 30, 3), ("b", "x.tex", 5, 1), ("b", "y.tex", 5, 2), ("c", "fig.png", 7, 1)]
ENTRIES = [
    (1, "<entry><id>http://host/abs/2101.00001v2</id><title> A\n  title </title><summary>Some  text</summary><published>2021-01-01T00:00:00Z</published><updated>2021-01-02T00:00:00Z</updated><primary_category term='cs.LG'/><category term='cs.LG'/><category term=' stat.ML '/><category term='cs.LG'/><category term=''/></entry>"),
    (2, "<entry><id>http://host/abs/hep-th/9901001v1</id><title>B</title><summary/><category term='hep-th'/></entry>"),
]
HIERARCHY = '{"zz":{"name":"Zed Studies","subcategories":{"zz.A":"Alpha","yy.B":"Beta one"}},"yy":{"name":"Why Studies","subcategories":{"yy.B":"Beta two","yy":"Why itself"}},"solo":{"name":"Solo"},"bare":{}}'


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def archives() -> list[tuple[str, bytes]]:
    """(archive, tar bytes) of MEMBERS; every member holds its own name, filled up to its size."""
    import io
    import tarfile

    out = []
    for name in sorted({m[0] for m in MEMBERS}):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            for _, member, size, _ in sorted((m for m in MEMBERS if m[0] == name), key=lambda m: m[3]):
                info = tarfile.TarInfo(member)
                info.size = size
                tar.addfile(info, io.BytesIO(member.ljust(size, "~").encode()))
        out.append((name, buffer.getvalue()))
    return out


#: Records a category of the paged source has.
PAGED = {"a": 7, "b": 2, "c": 0, "d": 12}


def page(category: str, start: int, size: int) -> list[dict]:
    return [{"category": category, "i": k} for k in range(start, min(start + size, PAGED.get(category, 0)))]


def values(rows: list, names: str) -> str:
    """The same rows as a SQL VALUES list."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            parts = ["'" + p.replace("'", "''") + "'" for p in v.replace("\x07", "\x00\x07").split("\x00\x07")]
            return "(" + " || chr(7) || ".join(parts) + ")" if len(parts) > 1 else parts[0]
        return str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"

"""Fill-in-the-middle arrangement of texts (after Bavarian et al., 2022), in Spark SQL expressions only.

``regexp_extract_all`` makes the array of a text's units: words with the white space before them, and white space that
no word follows. Four numbers are read from the SHA-256 of the seed and the row's id (``conv`` of eight hex digits each);
two are the places of the cuts among the units, one says whether the text is rearranged at all, one in which order.
Slices of the array, joined, are the prefix, middle and suffix, and sentinels mark them:

    psm   <P>prefix<S>suffix<M>middle          spm   <S>suffix<P>prefix<M>middle          plain   the text

A text that holds a sentinel stays plain, so the first place of each sentinel in an output is its own, and ``restored``
rebuilds the text from output and form. One projection of each row: no shuffle, and nothing beyond the row is held.

Null text is the empty text; empty texts are plain. A null id is the id "" (one draw for all such rows). The draw depends
on nothing but the id, so repeated rows give equal results. Texts of white space alone are one unit. Empty tables give
empty results; further columns are passed through by ``fill_in_middle``, which refuses tables that have a column of the
names it adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

#: A word with the white space before it, or white space at the end. Possessive: no text makes it go back.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
ADDED = ["n", "form", "prefix", "middle", "suffix", "output"]


@dataclass(frozen=True)
class Plan:
    """How texts are drawn: a seed, the percentage that is rearranged, of these the percentage in the order suffix first,
    and the sentinels before prefix, suffix and middle."""

    seed: int = 42
    rate: int = 50
    spm_rate: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.sentinels
        overlapping = any(a[i:] and b.startswith(a[i:]) for a in marks for b in marks for i in range(len(a)) if (i or a is not b))
        if not all(marks) or overlapping or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("sentinels must be non-empty, and none may begin within another one")
        if not (0 <= self.rate <= 100 and 0 <= self.spm_rate <= 100):
            raise ValueError("rates are percentages")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def draw(id_: Column, number: int, seed: int) -> Column:
    """The row's number-th draw (from 1): an unsigned integer of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """``docs`` with n (units), form, prefix, middle, suffix (null where plain) and output."""
    if taken := set(ADDED) & set(docs.columns):
        raise ValueError(f"these columns would be replaced: {sorted(taken)}")
    p, s, m = map(F.lit, plan.sentinels)
    h = {k: draw(F.col(id_col), k, plan.seed) for k in range(1, 5)}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = F.contains(text, p) | F.contains(text, s) | F.contains(text, m)
    form = F.when((text == "") | marked | (h[3] % 100 >= plan.rate), "plain").when(h[4] % 100 < plan.spm_rate, "spm").otherwise("psm")
    own = docs.columns
    cut = docs.select("*", text.alias("_text"), units(text).alias("_units"), form.alias("form")).select("*", F.size("_units").cast("bigint").alias("n"))
    a, b = h[1] % (F.col("n") + 1), h[2] % (F.col("n") + 1)
    placed = cut.select("*", F.least(a, b).cast("int").alias("_a"), F.greatest(a, b).cast("int").alias("_b"))
    rearranged = F.col("form") != "plain"
    part = lambda begin, size: F.when(rearranged, F.array_join(F.slice("_units", begin + 1, size), ""))
    parts = placed.select(
        *own, "_text", "n", "form",
        part(F.lit(0), F.col("_a")).alias("prefix"),
        part(F.col("_a"), F.col("_b") - F.col("_a")).alias("middle"),
        part(F.col("_b"), F.col("n").cast("int") - F.col("_b")).alias("suffix"),
    )
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    return parts.select(*own, *ADDED[:-1], output.alias("output"))


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text from an output and its form: what stands between sentinels, put together in the order of the text."""
    p, s, m = plan.sentinels

    def after(mark: str) -> Column:
        return F.substring(output, F.locate(mark, output) + len(mark), F.length(output))

    def between(mark: str, following: str) -> Column:
        begin = F.locate(mark, output) + len(mark)
        return F.substring(output, begin, F.locate(following, output) - begin)

    psm = F.concat(between(p, s), after(m), between(s, m))
    spm = F.concat(between(p, m), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text rebuilt from it."""
    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("bigint").alias("prefix_chars"),
        F.length("middle").cast("bigint").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+', 0) AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda k: list_reduce(list_transform(range(8), lambda i: (instr('0123456789abcdef', d[k + i : k + i]) - 1)::BIGINT), lambda x, y: x * 16 + y)) AS h FROM cut),
placed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""

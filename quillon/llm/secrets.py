"""Secret scans over an incremental ledger of blobs, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger lists, by blob and rule version, what was
found before. Only blobs whose pair is missing are scanned, each once however many rows hold it: the copies that a task
has are made one before the shuffle, so a group of copies is no hot key. What is new is written to the shared folder
(the caller may append it to a ledger that is kept), and the findings are joined back to all paths; rows of a blob that
very many paths share are spread over many tasks there.

Positions come from the built-in functions: a pattern's matches and the pieces between them (split by the same pattern)
alternate, so running sums of their lengths in code points give starts and ends. They are summed in runs of RUN matches,
so that a text of very many findings isn't copied anew for each of them.

Patterns repeat single character classes only, never groups: Java's regular expressions recurse over a repeated group,
and a long text could end the executor. No rule is followed far from more than one place of a run, so that the time is
in proportion to the text.

Null text is the empty text, and has no findings. Repeated rows give repeated results. Empty tables give empty results.
Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_classes, read

RULE_VERSION = "3"
#: Matches whose places are summed up together.
RUN = 256

# The base rules, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
# Rules that the method adds.
PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
GITHUB = r"gh[pousr]_[A-Za-z0-9]{36,}"
SLACK = r"xox[abprs]-[A-Za-z0-9-]{10,}"
#: Entered at the beginning of a run only: else each "eyJ" within a long run would be followed to the run's end.
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"

#: kind -> (cheap test, pattern, group whose length counts, its least length)
BASE_RULES = {
    "assign": (r"(?i)password|passwd|secret|token|api_?key", ASSIGN, 2, 6),
    "access": ("AKIA", ACCESS, 0, 20),
    "hex": (HEX, HEX, 0, 24),
}
ADDED_RULES = {
    "private_key": ("-----BEGIN ", PEM, 0, 1),
    "github": ("gh[pousr]_", GITHUB, 0, 1),
    "slack": ("xox[abprs]-", SLACK, 0, 1),
    "jwt": ("eyJ", JWT, 0, 1),
}
KINDS = [*BASE_RULES, *ADDED_RULES]


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _spans(text: Column, kind: str, rule: tuple[str, str, int, int]) -> Column:
    """Array of (start, stop, rank of the kind) of one rule; code points, stop exclusive."""
    test, pattern, group, least = rule
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    sizes = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), lambda x: F.length(x)).alias("gap"), F.transform(found, lambda x: F.length(x)).alias("own"), F.transform(counted, lambda x: F.length(x)).alias("counted"))
    none = F.array().cast("array<struct<start:int,stop:int,rank:int>>")
    # a matchless text has one run without matches
    run_of = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(m), F.lit(1)) - 1) / RUN).cast("int")), lambda k: F.slice(m, k * RUN + 1, RUN))
    total = lambda m: F.aggregate(m, F.lit(0), lambda s, x: s + x["gap"] + x["own"])

    def begins(runs):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(runs, start, lambda acc, m: F.struct((acc["at"] + total(m)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def step(acc, x):
        start = acc["at"] + x["gap"]
        stop = start + x["own"]
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), F.lit(KINDS.index(kind)).alias("rank")))
        return F.struct(stop.alias("at"), F.when(x["counted"] >= least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    def placed(at, m):
        return F.aggregate(m, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    # bound to names, matches and runs are found once
    spans = F.transform(F.transform(F.array(sizes), run_of), lambda runs: F.flatten(F.zip_with(begins(runs), runs, placed)))[0]
    return F.when(text.rlike(test), spans).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["stop"]))), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob, text) -> findings of each blob: the ledger's rows for this rule version."""
    rules = BASE_RULES | ADDED_RULES
    spanned = blobs.select("blob", *(_spans(F.col("text"), k, r).alias(k) for k, r in rules.items()))
    base = F.concat(*BASE_RULES)
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in rules]
    return spanned.select("blob", F.lit(rule_version).alias("rule_version"), *counts, _joined(base).alias("base_spans"), _joined(F.concat(*rules)).alias("spans"))


def unseen(stored: DataFrame, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """One (blob, text) for each blob of ``stored`` that the ledger hasn't for this rule version."""
    texts = stored.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return texts
    return texts.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scans the rows of (path, text) against a ledger of earlier scans.

    A path may have many rows, one for each historical version. Returns (path, blob, findings) of every row, and the
    ledger's new rows, which are in the shared folder, for the caller to append. A ledger has the columns that ``scan``
    returns.
    """
    stored = versions.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    paths = cut(stored.select("path", "blob"))
    fresh = cut(scan(unseen(stored.select("blob", "text"), ledger, rule_version), rule_version))
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule_version") == rule_version).select(*fresh.columns))
    return join_classes(paths, known, "blob"), fresh


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Findings of every document row. Without a ledger, nothing has been scanned before."""
    found, _ = scan_versions(docs.select(F.col("doc_id").cast("bigint").alias("path"), "text"), ledger)
    return found.withColumnRenamed("path", "doc_id")


DIGEST = ["doc_id", "n_assign", "n_access", "n_hex"]


def op8_secret_blob_ledger(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    return digest(scan_documents(read(spark, sf_dir, "documents")))


def digest(found: DataFrame) -> DataFrame:
    return found.select(*DIGEST, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def secret_ledger_versions(spark, sf_dir: str) -> DataFrame:
    """What op8 finds, by a second scan over a ledger: the first version of the corpus held every other document, and an
    earlier text (its own without the first word) of the rest; the second scan looks only at blobs that are new."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", r"^\S*", ""))
    _, ledger = scan_versions(docs.select(F.col("doc_id").cast("bigint").alias("path"), earlier.alias("text")))
    return digest(scan_documents(docs, ledger))


def drop_secrets(docs: DataFrame) -> DataFrame:
    """The documents in which no rule finds anything; all columns stay. Rows of one id and text stay or go together."""
    found = scan_documents(docs).where("spans <> ''").select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(found["_id"]) & (blob_id(F.coalesce(docs["text"], F.lit(""))) == found["_blob"])
    return docs.join(found, same, "left_anti")


_DUCK_KIND = """
  {k}_m AS (SELECT blob, text, regexp_extract_all(text, '{p}', 0) AS f, regexp_extract_all(text, '{p}', {g}) AS c, {e} AS e, string_split_regex(text, '{p}') AS s FROM blobs),
  {k}_s AS (SELECT blob, unnest(range(1, len(f) + 1)) AS i, f, c, e, s FROM {k}_m WHERE len(f) > 0),
  {k} AS (SELECT blob, list_sum(list_transform(s[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0)::BIGINT + coalesce(length(e[i]), 0) AS a, length(f[i]) - coalesce(length(e[i]), 0) AS n, {r} AS rank, '{k}' AS kind FROM {k}_s WHERE length(c[i]) >= {least})"""

#: What DuckDB's patterns lack: the character before a run is matched, and taken off, instead of looked back at.
_BEFORE = "(?<![A-Za-z0-9_-])"


def _duck_kind(k: str, rank: int) -> str:
    _, p, g, least = (BASE_RULES | ADDED_RULES)[k]
    p, guarded = p.replace("'", "''").replace("}+", "}"), p.startswith(_BEFORE)
    if guarded:
        p = p.replace(_BEFORE, "(^|[^A-Za-z0-9_-])")
    return _DUCK_KIND.format(k=k, p=p, g=g, least=least, r=rank, e=f"regexp_extract_all(text, '{p}', 1)" if guarded else "[]::VARCHAR[]")


def _oracle() -> str:
    kinds = [_duck_kind(k, i) for i, k in enumerate(KINDS)]
    spans = " UNION ALL ".join(f"SELECT blob, a, a + n AS b, rank, kind FROM {k}" for k in KINDS)
    return f"""WITH blobs AS (SELECT DISTINCT coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),{",".join(kinds)},
  spans AS ({spans}),
  found AS (SELECT blob, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, rank, b) FILTER (rank < 3), '') AS base, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, rank, b) AS spans FROM spans GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found ON found.blob = sha256(coalesce(text, ''))"""


ORACLE = _oracle()

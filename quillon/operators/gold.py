"""Question sets: sampling, candidates, human review, validation, splitting, and held-out texts.

Where an order must be random, rows are ordered by a seeded hash of their id, which any engine can repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UserError
from ..functions import text as T
from ..sources.store import written
from .retrieval import distractors
from .select import least_keys

# Kinds of questions, decisions of reviewers, columns of the review file.
KINDS = ("factual", "procedimental", "sem_resposta")
UNANSWERABLE = "sem_resposta"
DECISIONS = ("aceitar", "editar", "descartar")
REVIEW_COLUMNS = "id tipo tema_id evidencia pergunta resposta_ref texto_evidencia decisao pergunta_corrigida resposta_corrigida observacao".split()
REQUIRED = ("id", "pergunta", "resposta_ref", "evidencia", "tipo")
MIN_SAMPLE_TOKENS, MAX_ATTEMPTS = 120, 3


def shuffled(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *ids))


def quotas(counts: DataFrame, n: int, group: str = "grp") -> DataFrame:
    """(group, size, quota) from (group, size): n in proportion to size, each group one if n allows, by largest remainder.

    No quota exceeds its group: what is left over goes round again, which the largest remainder never needs more than
    once here, as no share exceeds its group's size. Groups may be any number: their totals are sums, and the largest
    remainders are found by counting their digits. ``counts`` is written, as it is read several times.
    """
    counts = written(counts.select(group, "size"))
    all_ = counts.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    n = min(n, all_.total)
    base = 1 if n >= all_.groups else 0
    room = all_.total - base * all_.groups
    ideal = (n - base * all_.groups) * (F.col("size") - base) / F.lit(room) if room > 0 else F.lit(0.0)
    # the larger the remainder, the less the key; at nine decimals, ties in the order of a hash
    rest = F.lit(10**9) + F.round(F.round(F.floor("ideal") - F.col("ideal"), 9) * 10**9).cast("bigint")
    t = counts.withColumn("ideal", ideal).withColumn("whole", (base + F.floor("ideal")).cast("bigint"))
    t = t.withColumn("key", F.concat(F.lpad(F.lower(F.hex(rest)), 9, "0"), F.md5(F.coalesce(F.col(group).cast("string"), F.lit("")))))
    left = n - (t.agg(F.sum("whole")).first()[0] or 0)
    more = least_keys(t, F.col("key"), 41, left) & (F.col("whole") < F.col("size"))
    return t.select(group, "size", (F.col("whole") + F.when(more, 1).otherwise(0)).alias("quota"))


def stratified_sample(rows: DataFrame, n: int, group: str, id_col: str = "id", seed: int = 42) -> DataFrame:
    """n rows (all, if there are fewer), spread over the groups by their size; groups may be large: numbers are found
    within hash parts of a group first, of which only as many as the quota go on."""
    named = rows.withColumn("_h", shuffled(seed, F.col(id_col).cast("string"))).withColumn("grp", F.col(group))
    share = quotas(named.groupBy("grp").agg(F.count("*").alias("size")), n)
    near = named.join(share.where("quota > 0").select("grp", "quota"), "grp").withColumn("_part", F.substring("_h", 1, 2))
    first = near.withColumn("_k", F.row_number().over(Window.partitionBy("grp", "_part").orderBy("_h", id_col))).where("_k <= quota")
    return first.withColumn("_k", F.row_number().over(Window.partitionBy("grp").orderBy("_h", id_col))).where("_k <= quota").drop("_k", "_part", "_h", "grp", "quota")


def tasks(chunks: DataFrame, n: int, unanswerable_share: float = 0.2, seed: int = 42) -> DataFrame:
    """(place, kind, chunk columns): what a generator is asked for. Two samples; of five answerable, two are procedural."""
    if n < 1:
        raise UserError("the number of questions must be positive")
    without = round(n * unanswerable_share)
    able = chunks.where(F.col("n_tokens") >= MIN_SAMPLE_TOKENS)

    def placed(sample: DataFrame, own: int, base: int) -> DataFrame:
        order = Window.partitionBy(F.lit(0)).orderBy(shuffled(own, F.lit("order"), F.col("id").cast("string")))  # n rows
        return sample.withColumn("place", F.row_number().over(order) - 1 + base)

    answered = placed(stratified_sample(able, n - without, "section_id", seed=seed), seed, 0).withColumn("kind", F.when((F.col("place") % 5).isin(1, 3), "procedimental").otherwise("factual"))
    other = placed(stratified_sample(able, without, "section_id", seed=seed + 1), seed + 1, n - without).withColumn("kind", F.lit(UNANSWERABLE))
    return answered.unionByName(other)


def candidates(tasks_: DataFrame, replies: DataFrame, phrase: str) -> DataFrame:
    """Candidate questions from (place, attempt, reply): the first reply whose object has the keys, if any.

    Numbered q001, q002, ... over those that succeeded.
    """
    parsed = T.json_object(F.col("reply"), "pergunta string, resposta string")
    said = replies.select("place", "attempt", parsed.alias("o")).where(F.col("attempt") < MAX_ATTEMPTS)
    joined = tasks_.join(said, "place")
    full = (T.strip(F.col("o.pergunta")) != "") & ((F.col("kind") == UNANSWERABLE) | (T.strip(F.col("o.resposta")) != ""))
    first = joined.where(full).groupBy("place").agg(F.min("attempt").alias("attempt"))
    good = joined.join(first, ["place", "attempt"])
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place")).cast("string")  # as many as were asked for
    return good.select(
        F.concat(F.lit("q"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))).alias("id"),
        T.strip(F.col("o.pergunta")).alias("pergunta"),
        F.when(F.col("kind") == UNANSWERABLE, F.lit(phrase)).otherwise(T.strip(F.col("o.resposta"))).alias("resposta_ref"),
        F.when(F.col("kind") == UNANSWERABLE, F.array().cast("array<string>")).otherwise(F.array(F.col("id").cast("string"))).alias("evidencia"),
        F.col("kind").alias("tipo"),
        F.col("section_id").alias("tema_id"),
        F.lit("gerado").alias("origem"),
        F.lit(False).alias("revisado"),
        F.col("id").alias("trecho_origem"),
    )


def generation_stats(tasks_: DataFrame, replies: DataFrame, made: DataFrame) -> DataFrame:
    """(asked, made, attempts, valid_share)."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    joined = n(tasks_, "asked").join(F.broadcast(n(made, "made"))).join(F.broadcast(n(replies, "attempts")))
    return joined.withColumn("valid_share", F.when(F.col("attempts") > 0, F.round(F.col("made") / F.col("attempts"), 3)).otherwise(0.0))


def review_table(candidates_: DataFrame, chunks: DataFrame) -> DataFrame:
    """The review file's rows: evidence ids joined by a bar, and their texts; unanswerable ones show their origin."""
    ids = F.when(F.size("evidencia") > 0, F.col("evidencia")).otherwise(F.array("trecho_origem"))
    texts = chunks.select(F.col("id").alias("_id"), F.col("text").alias("_text"))
    shown = candidates_.select("id", F.posexplode(ids).alias("_pos", "_id")).join(texts, "_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_pos", "_text"))).alias("t"))
    prefix = F.when(F.col("tipo") == UNANSWERABLE, F.lit("[trecho de origem; a resposta NÃO deve estar no manual] ")).otherwise(F.lit(""))
    text = F.concat(prefix, F.coalesce(F.array_join(F.transform("t", lambda x: x["_text"]), "\n---\n"), F.lit("")))
    empty = [F.lit("").alias(c) for c in ("decisao", "pergunta_corrigida", "resposta_corrigida", "observacao")]
    return candidates_.join(shown, "id", "left").select("id", "tipo", F.coalesce("tema_id", F.lit("")).alias("tema_id"), F.array_join("evidencia", "|").alias("evidencia"), "pergunta", "resposta_ref", text.alias("texto_evidencia"), *empty)


def reviewed(rows: DataFrame, phrase: str, line_col: str = "line") -> DataFrame:
    """Each row of a review file (with its line number) as it is imported, with ``error`` (null if none) and ``kept``.

    A row is judged in this order: decision missing, decision unknown, id seen before among judged rows, discarded,
    kind unknown, edit without a change, answerable without evidence.
    """
    s = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    t = rows.withColumn("_id", s("id")).withColumn("_d", F.lower(s("decisao"))).withColumn("_kind", s("tipo"))
    known = F.col("_d").isin(*DECISIONS)
    seen = F.row_number().over(Window.partitionBy("_id", known).orderBy(line_col)) > 1
    t = t.withColumn("_again", known & seen).withColumn("_edit", F.col("_d") == "editar")
    t = t.withColumn("_ev", T.evidence_ids(F.coalesce("evidencia", F.lit(""))))
    new_q, new_a = s("pergunta_corrigida"), s("resposta_corrigida")
    error = (
        F.when(F.col("_d") == "", "no decision")
        .when(~known, "unknown decision")
        .when(F.col("_again"), "repeated id")
        .when(F.col("_d") == "descartar", F.lit(None))
        .when(~F.col("_kind").isin(*KINDS), "unknown kind")
        .when(F.col("_edit") & (new_q == "") & (new_a == ""), "edit without a change")
        .when((F.col("_kind") != UNANSWERABLE) & (F.size("_ev") == 0), "no evidence")
    )
    changed = lambda new, old: F.when(F.col("_edit") & (new != ""), new).otherwise(old)
    none = F.col("_kind") == UNANSWERABLE
    return t.select(
        F.col(line_col).alias("line"),
        F.col("_id").alias("id"),
        changed(new_q, s("pergunta")).alias("pergunta"),
        F.when(none, F.lit(phrase)).otherwise(changed(new_a, s("resposta_ref"))).alias("resposta_ref"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.col("_ev")).alias("evidencia"),
        F.col("_kind").alias("tipo"),
        s("tema_id").alias("tema_id"),
        F.when(F.col("_edit"), "editado").otherwise("gerado").alias("origem"),
        F.lit(True).alias("revisado"),
        error.alias("error"),
        (error.isNull() & (F.col("_d") != "descartar")).alias("kept"),
    )


def imported(rows: DataFrame, phrase: str) -> DataFrame:
    """The kept items of a review file; any error refuses the whole file."""
    judged = reviewed(rows, phrase)
    bad = judged.where("error is not null").orderBy("line").limit(20).collect()
    if bad:
        raise UserError("review incomplete or wrong: " + "; ".join(f"line {r.line} ({r.id}): {r.error}" for r in bad))
    return judged.where("kept").drop("error", "kept", "line")


def violations(items: DataFrame, order: str) -> DataFrame:
    """(id, error) of a question set: fields missing, kinds unknown, evidence no list, ids repeated."""
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED))
    again = (F.row_number().over(Window.partitionBy("id").orderBy(order)) > 1) & F.col("id").isNotNull()
    t = items.withColumn("_m", missing).withColumn("_again", again)
    found = F.when(F.col("_m") != "", F.array(F.concat(F.lit("missing: "), F.col("_m")))).otherwise(
        F.filter(F.array(F.when(~F.col("tipo").isin(*KINDS), F.lit("unknown kind")), F.when(F.col("_again"), F.lit("repeated id"))), lambda x: x.isNotNull())
    )
    return t.select("id", order, F.explode(found).alias("error"))


def split_groups(sizes: list[tuple[str, int, int]], share: float, seed: int, attempts: int = 200) -> set[str]:
    """The groups of the smaller split, from (group, items, unanswerable items).

    Groups in the order of a seeded hash are added while that brings the split's size closer to its share. Other seeds
    are tried until both splits have items, and unanswerable ones if there are any.
    """
    goal = share * sum(n for _, n, _ in sizes)
    some = sum(u for _, _, u in sizes) > 0
    for attempt in range(attempts):
        chosen = nearest_groups(sizes, goal, seed + attempt)
        inside = sum(u for g, _, u in sizes if g in chosen)
        outside = sum(u for g, _, u in sizes if g not in chosen)
        if 0 < len(chosen) < len(sizes) and (not some or (inside and outside)):
            return chosen
    return set()


def nearest_groups(sizes: list[tuple[str, int, int]], goal: float, seed: int) -> set[str]:
    """Groups in the order of a seeded hash, each taken if that brings the sum of sizes closer to the goal."""
    chosen, n = set(), 0
    for g, size, _ in sorted(sizes, key=lambda x: hashlib.md5(f"{seed}:{x[0]}".encode()).hexdigest()):
        if abs(n + size - goal) < abs(n - goal):
            chosen.add(g)
            n += size
    return chosen


def split(items: DataFrame, share: float = 0.3, seed: int = 42, group: str = "tema_id") -> DataFrame:
    """Adds ``split`` (dev or test): all items of a group are on one side.

    Group sizes, not items, come to the driver. If no seed serves, the groups of answerable items are dealt out by the
    first seed, and the unanswerable items, which have no evidence, by themselves; a side without items is an error.
    """
    flagged = items.withColumn("_u", (F.col("tipo") == UNANSWERABLE).cast("int")).withColumn("_g", F.coalesce(group, F.lit("")))
    sizes = [(r.g, r.n, r.u) for r in flagged.groupBy(F.col("_g").alias("g")).agg(F.count("*").alias("n"), F.sum("_u").alias("u")).collect()]
    if len(sizes) < 2:
        raise UserError("a split needs two groups at least")
    chosen = split_groups(sizes, share, seed)
    side = lambda c: F.when(c, "dev").otherwise("test")
    spark = items.sparkSession
    if chosen:
        marks = spark.createDataFrame([(g,) for g in sorted(chosen)], "_g string").withColumn("_dev", F.lit(True))
        return flagged.join(F.broadcast(marks), "_g", "left").withColumn("split", side(F.coalesce("_dev", F.lit(False)))).drop("_g", "_u", "_dev")
    able = [(g, n - u, 0) for g, n, u in sizes if n > u]
    chosen = nearest_groups(able, share * sum(n for _, n, _ in able), seed)
    marks = spark.createDataFrame([(g,) for g in sorted(chosen)], "_g string").withColumn("_dev", F.lit(True))
    n = sum(u for _, _, u in sizes)
    first = min(n - 1, max(1, round(share * n)))
    if not (chosen or first > 0) or not (len(chosen) < len(able) or first < n):
        raise UserError("no split with items on both sides")
    order = Window.partitionBy("_u").orderBy(shuffled(seed, F.col("id")))
    dealt = flagged.where("_u = 1").withColumn("_k", F.row_number().over(order)).withColumn("split", side(F.col("_k") <= first)).drop("_k")
    return flagged.where("_u = 0").join(F.broadcast(marks), "_g", "left").withColumn("split", side(F.coalesce("_dev", F.lit(False)))).drop("_dev").unionByName(dealt).drop("_g", "_u")


def held_out_chunks(chunks: DataFrame, test_items: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """n chunks of sections without a test item, by id."""
    taken = test_items.select(F.coalesce("tema_id", F.lit("")).alias("section_id")).distinct()
    return chunks.join(taken, "section_id", "left_anti").orderBy(shuffled(seed, F.col("id").cast("string")), "id").limit(n)


def held_out_text(chunks: DataFrame) -> DataFrame:
    """One row: the chunks' texts by id, a blank line between. For a held-out sample, not for a corpus."""
    texts = F.array_sort(F.collect_list(F.struct("id", "text")))
    return chunks.agg(F.concat(F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))


def training_examples(prompts: DataFrame, validation_share: float = 0.05, seed: int = 42, most_tokens: int = 2048, per_word: float = 1.3) -> DataFrame:
    """(id, prompt, answer, part): examples within the token limit, split by a seeded hash."""
    size = T.token_estimate(F.size(T.words(F.concat_ws(" ", "prompt", "answer"))), per_word)
    fits = prompts.where(size <= most_tokens).withColumn("_h", shuffled(seed, F.col("id").cast("string")))
    share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    return fits.withColumn("part", F.when(share < validation_share, "validation").otherwise("train")).drop("_h")


def training_tasks(chunks: DataFrame, n: int = 1500, unanswerable_share: float = 0.2, seed: int = 42, least_tokens: int = 40) -> DataFrame:
    """(place, kind, chunk columns): n chunks of ``least_tokens`` or more (all, if there are fewer), the first ones for
    questions without an answer; of five others, two are procedural."""
    turn = shuffled(seed, F.col("id").cast("string"))
    sample = written(chunks.where(F.col("n_tokens") >= least_tokens).orderBy(turn, "id").limit(n))  # read for each step from question to example
    t = sample.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(turn, "id")) - 1)  # n rows
    without = F.bround(F.count("*").over(Window.partitionBy(F.lit(0))) * F.lit(unanswerable_share))
    return t.withColumn("kind", F.when(F.col("place") < without, UNANSWERABLE).when((F.col("place") % 5).isin(1, 3), "procedimental").otherwise("factual"))


def training_set(tasks_: DataFrame, replies: DataFrame, chunks: DataFrame, search: Callable[[DataFrame], DataFrame], template: str, phrase: str, validation_share: float = 0.05, seed: int = 42, budget: int = 1400, most_tokens: int = 2048, per_word: float = 1.3) -> DataFrame:
    """(id, prompt, answer, part, n_chunks) from generated questions; id is the chunk that a question was made from.

    chunks: (id, n_tokens, section_id, section, page_start, text). search: questions (q_id, text) to ranked chunks, of
    which those to rank 7 are used. The prompt (``{contexto}``, ``{pergunta}`` of the template) shows the chunk and two
    to four distractors, all in the order of a seeded hash. Citations are taken out of the answer and the chunk's own is
    appended; without an answer it is the phrase. Only questions and ids are sent to the texts, which are not shuffled. The first share in the order of a hash is for validation; examples
    beyond the token limit are left out after that.
    """
    key = lambda *x: shuffled(seed, *(F.lit(c) if isinstance(c, str) else c.cast("string") for c in x))
    made = candidates(tasks_, replies, f"{phrase}.").select(F.col("trecho_origem").alias("q_id"), "pergunta", "resposta_ref", "tipo").persist()  # as many as were asked for
    n = F.conv(F.substring(key("distractors", F.col("q_id")), 1, 8), 16, 10).cast("bigint") % 3 + 2
    asked = made.select("q_id", n.alias("wanted"))
    ranked = search(made.select("q_id", F.col("pergunta").alias("text"))).join(asked, "q_id").where(F.col("rank") <= F.col("wanted") + 3).select("q_id", "id", "rank")
    evidence = made.select("q_id", F.col("q_id").alias("id"))
    # whoever wants fewer takes the first of them
    beside = distractors(ranked, evidence, chunks, 4, budget, seed).join(asked, "q_id").where("place < wanted").select("q_id", F.col("id").cast("string").alias("id"))
    shown = beside.unionByName(evidence.withColumn("id", F.col("id").cast("string"))).withColumn("turn", key("order", F.col("q_id"), F.col("id")))
    told = chunks.select(F.col("id").cast("string").alias("id"), "section_id", "section", "page_start", "text")
    listed = told.join(F.broadcast(shown), "id").groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "section_id", "section", "page_start", "text"))).alias("c"))
    own = chunks.select(F.col("id").alias("q_id"), F.concat(F.lit("(seção "), T.section_label(F.col("section_id"), F.col("section")), F.lit(", p. "), F.col("page_start").cast("string"), F.lit(")")).alias("cited"))
    answer = F.when(F.col("tipo") == UNANSWERABLE, F.col("resposta_ref")).otherwise(F.concat(F.regexp_replace(T.without_citations(F.col("resposta_ref")), "[ .]+$", ""), F.lit(" "), F.col("cited")))
    t = own.join(F.broadcast(made), "q_id").join(listed, "q_id").select(F.col("q_id").alias("id"), T.fill(template, contexto=T.context(F.col("c")), pergunta=F.col("pergunta")).alias("prompt"), answer.alias("answer"), F.size("c").alias("n_chunks"))
    every = Window.partitionBy(F.lit(0))
    first = F.greatest(F.lit(1), F.bround(F.count("*").over(every) * F.lit(validation_share)))
    t = t.withColumn("part", F.when(F.row_number().over(every.orderBy(key("split", F.col("id")), "id")) <= first, "validation").otherwise("train"))
    return t.where(T.token_estimate(F.size(T.words(F.concat_ws(" ", "prompt", "answer"))), per_word) <= most_tokens)

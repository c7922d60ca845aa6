"""Text generation metrics over reply pairs, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import genmetrics as gm
from parley.operators.classmetrics import class_f1, leaderboard
from parley.plans import corpus
from parley.plans.cascade_queries import f1_sql
from parley.plans.corpus_sql import LABELLED, PAIRS, punct, words
from parley.schema import CLASSIFIERS, GENERATOR_ORDER

BY = ["llm_alias", "classifier"]
KEY = ["conv_id", "turn"]


def _tokens(spark: SparkSession, folder: str, tokenizer: str = "words") -> DataFrame:
    return gm.tokenized(corpus.reply_pairs(spark, folder), BY, KEY, tokenizer=tokenizer)


def _rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


def bleu(spark: SparkSession, folder: str) -> DataFrame:
    rows = gm.row_scores(_tokens(spark, folder), rouge=False, soft=False)
    sums = rows.groupBy(*BY).agg(*gm.bleu_parts())
    counts = [c for c in sums.columns if c not in BY]
    scores = [F.round(100 * gm.bleu_of(k), 6).alias(f"bleu_{k}") for k in (1, 2, 3, 4)]
    return sums.select(*BY, *counts, *scores)


def bleu_punctuation(spark: SparkSession, folder: str) -> DataFrame:
    """BLEU over all pairs as one group, on punctuation tokens without contractions."""
    tokens = gm.tokenized(corpus.reply_pairs(spark, folder), [], KEY, tokenizer="punctuation")
    sums = gm.row_scores(tokens, rouge=False, soft=False).agg(*gm.bleu_parts())
    return sums.select("*", *[F.round(100 * gm.bleu_of(k), 6).alias(f"bleu_{k}") for k in (1, 2)])


def distinct_k(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(gm.distinct_k(_tokens(spark, folder), BY), BY)


def unigram_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Per pair; the report averages these."""
    rows = gm.row_scores(_tokens(spark, folder), rouge=False, soft=False)
    return rows.select(*KEY, "m1", F.round("f1", 6).alias("f1"))


def lcs(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(spark, folder).select(*KEY, gm.lcs_length("hyp", "ref").alias("lcs"))


def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tokens(spark, folder).select(
        *BY, F.size("hyp").alias("h"), F.size("ref").alias("r"), gm.lcs_length("hyp", "ref").alias("lcs")
    )
    score = gm.rouge_l(F.col("lcs"), F.col("h"), F.col("r"))
    return rows.groupBy(*BY).agg(F.round(100 * F.avg(score), 6).alias("rouge_l"))


def soft_match_f1(spark: SparkSession, folder: str) -> DataFrame:
    score = gm.trigram_match_f1("hyp", "ref")
    return _tokens(spark, folder).select(*KEY, F.round(score, 6).alias("soft_match"))


def soft_match_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Soft match with given vectors: here a word's vector counts a few of its letters."""
    pairs = corpus.reply_pairs(spark, folder)
    words_seen = pairs.select(F.explode(gm.word_tokens(F.col("llm_parsed_response"))).alias("token")).union(
        pairs.select(F.explode(gm.word_tokens(F.col("reference_response"))))
    )
    letters = [
        (F.length("token") - F.length(F.replace("token", F.lit(c), F.lit("")))).cast("double") for c in "etanio"
    ]
    vectors = words_seen.distinct().select("token", F.array(F.lit(1.0), *letters).alias("vector"))
    scored = gm.soft_match_with_vectors(pairs, vectors, KEY)
    return scored.select(*KEY, F.round("soft_match", 6).alias("soft_match"))


def _metrics(spark: SparkSession, folder: str, by: list[str] | None = None) -> DataFrame:
    return gm.evaluate_generation(corpus.reply_pairs(spark, folder), by or BY, KEY)


def generation_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_metrics(spark, folder), [*BY, "pairs"])


def generation_quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship report: all text metrics per generator and classifier, rounded to two places."""
    rank = F.array_position(F.array(*[F.lit(g) for g in GENERATOR_ORDER]), F.col("llm_alias"))
    table = gm.summary(_metrics(spark, folder), "classifier", keep=("llm_alias",))
    return table.orderBy(F.when(rank > 0, rank).otherwise(len(GENERATOR_ORDER) + 1), "llm_alias", "model")


def ablation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The same report by prompt variant, read from columns named as in the ablation files."""
    variant = F.element_at(
        F.array(*[F.lit(v) for v in ("llm_only", "strategy_probability", "stage_information")]),
        (F.col("conv_id") % 3 + 1).cast("int"),
    )
    rows = corpus.reply_pairs(spark, folder).withColumnRenamed("llm_parsed_response", "llm_response")
    scored = gm.evaluate_generation(rows.withColumn("variant", variant), ["variant"], KEY, hyp="llm_response")
    return gm.summary(scored, "variant")


def models_compared(spark: SparkSession, folder: str) -> DataFrame:
    """Generators with both kinds of metric, and one model that only predicts labels."""
    turns = corpus.labelled_turns(spark, folder).select(
        "strategy_true", "strategy_pred", corpus.generator_name().alias("model"), "stage_true", "stage_pred"
    )
    label_only = turns.select(
        F.lit("labels only").alias("model"),
        F.col("stage_true").alias("strategy_true"),
        F.col("stage_pred").alias("strategy_pred"),
    )
    both = turns.select("model", "strategy_true", "strategy_pred").unionByName(label_only)
    classes = class_f1(both, "strategy_true", "strategy_pred", ["model"])
    texts = _metrics(spark, folder, ["llm_alias"]).withColumnRenamed("llm_alias", "model")
    return leaderboard(texts, classes)


def missing_results(spark: SparkSession, folder: str) -> DataFrame:
    found = corpus.reply_pairs(spark, folder)
    expected = [(g, c) for g in ("m0", "m1", "m2", "m3") for c in ("c0", "c1", *CLASSIFIERS)]
    return gm.missing_results(found, expected)


QUERIES = {
    "bleu": bleu,
    "bleu_punctuation": bleu_punctuation,
    "distinct_k": distinct_k,
    "unigram_f1": unigram_f1,
    "lcs": lcs,
    "rouge_l": rouge_l,
    "soft_match_f1": soft_match_f1,
    "soft_match_vectors": soft_match_vectors,
    "generation_quality": generation_quality,
    "generation_quality_summary": generation_quality_summary,
    "ablation_summary": ablation_summary,
    "leaderboard": models_compared,
    "missing_results": missing_results,
}


def _tokenized(cut) -> str:
    return f"""{PAIRS},
tok AS (SELECT conv_id, turn, llm_alias, classifier, {cut('llm_parsed_response')} AS h, {cut('reference_response')} AS r FROM pairs)"""


_GRAMS = """
sides AS (SELECT conv_id, turn, 'h' AS side, h AS l FROM tok UNION ALL SELECT conv_id, turn, 'r', r FROM tok),
gram AS (SELECT conv_id, turn, side, n, unnest(list_transform(range(1, len(l) - n + 2), lambda i: array_to_string(l[i:i+n-1], ' '))) AS g
  FROM sides, (SELECT unnest([1, 2, 3, 4]) AS n)),
counted AS (SELECT conv_id, turn, n, g, count_if(side = 'h') AS ch, count_if(side = 'r') AS cr FROM gram GROUP BY ALL),
clipped AS (SELECT conv_id, turn, n, sum(least(ch, cr)) AS m FROM counted GROUP BY ALL),
per_row AS (
  SELECT t.*, len(h) AS hl, len(r) AS rl, """ + ", ".join(
    f"coalesce((SELECT m FROM clipped c WHERE c.conv_id = t.conv_id AND c.turn = t.turn AND n = {n}), 0) AS m{n}" for n in (1, 2, 3, 4)
) + " FROM tok t)"

_SUMS = ", ".join(
    f"CAST(sum(m{n}) AS bigint) AS \"N{n}\", CAST(sum(greatest(hl - {n - 1}, 1)) AS bigint) AS \"D{n}\"" for n in (1, 2, 3, 4)
) + ', CAST(sum(hl) AS bigint) AS "H", CAST(sum(rl) AS bigint) AS "R"'


def _bleu_sql(k: int) -> str:
    precisions = []
    seen = "0"
    for n in (1, 2, 3, 4):
        empty = f'("N{n}" = 0 AND "H" > 1)'
        seen = f"{seen} + CASE WHEN {empty} THEN 1 ELSE 0 END"
        precisions.append(f'(CASE WHEN {empty} THEN ln(greatest("H", 2)) / (pow(2, {seen}) * 5) ELSE "N{n}" END / "D{n}")')
    usable = '"N1" > 0 AND ' + " AND ".join(f"{p} > 0" for p in precisions)
    logs = " + ".join(f"ln({p}) / {k}" for p in precisions[:k])
    return f'CASE WHEN {usable} THEN CASE WHEN "H" > "R" THEN 1 ELSE exp(1 - "R" / greatest("H", 1)) END * exp({logs}) ELSE 0 END'


_F1 = "(2.0 * m1 / greatest(hl + rl, 1))"
# one row of the classic table per step; the fold runs along the reference
_LCS = """
steps AS (
  WITH RECURSIVE walk AS (
    SELECT conv_id, turn, h, r, 0 AS i, list_transform(range(len(r) + 1), lambda x: CAST(0 AS bigint)) AS row FROM tok
    UNION ALL
    SELECT conv_id, turn, h, r, i + 1,
      list_reduce(range(1, len(r) + 1), lambda acc, j: list_append(acc, greatest(acc[-1], row[j + 1],
        CASE WHEN r[j] = h[i + 1] THEN row[j] + 1 ELSE 0 END)), [CAST(0 AS bigint)])
    FROM walk WHERE i < len(h))
  SELECT * FROM walk WHERE i = len(h)),
lengths AS (SELECT conv_id, turn, row[-1] AS lcs FROM steps)"""
_ROUGE = "(CASE WHEN lcs > 0 THEN 2.44 * (lcs / len(h)) * (lcs / len(r)) / (lcs / len(r) + 1.44 * (lcs / len(h))) ELSE 0 END)"
_SOFT = """
vocab AS (SELECT DISTINCT unnest(h || r) AS t FROM tok),
tri AS (SELECT t, g, count(*) AS c FROM (SELECT t, unnest(list_transform(range(1, length(t) + 1), lambda i: substr(' ' || t || ' ', i, 3))) AS g FROM vocab) GROUP BY ALL),
norm AS (SELECT t, sum(c * c) AS q FROM tri GROUP BY t),
hu AS (SELECT conv_id, turn, t, count(*) AS k FROM (SELECT conv_id, turn, unnest(h) AS t FROM tok) GROUP BY ALL),
ru AS (SELECT conv_id, turn, t, count(*) AS k FROM (SELECT conv_id, turn, unnest(r) AS t FROM tok) GROUP BY ALL),
couples AS (SELECT DISTINCT hu.t AS a, ru.t AS b FROM hu JOIN ru USING (conv_id, turn)),
dots AS (SELECT a, b, sum(x.c * y.c) AS dot FROM couples JOIN tri x ON x.t = a JOIN tri y ON y.t = b AND x.g = y.g GROUP BY ALL),
sims AS (SELECT a, b, dot / sqrt(CAST(na.q * nb.q AS double)) AS sim FROM dots JOIN norm na ON na.t = a JOIN norm nb ON nb.t = b),
hits AS (SELECT hu.conv_id, hu.turn, hu.t AS a, ru.t AS b, sim FROM hu JOIN ru USING (conv_id, turn) JOIN sims ON sims.a = hu.t AND sims.b = ru.t),
pr AS (SELECT conv_id, turn, sum(coalesce(best, 0) * k) / sum(k) AS p FROM hu LEFT JOIN (SELECT conv_id, turn, a AS t, max(sim) AS best FROM hits GROUP BY ALL) USING (conv_id, turn, t) GROUP BY ALL),
rc AS (SELECT conv_id, turn, sum(coalesce(best, 0) * k) / sum(k) AS rec FROM ru LEFT JOIN (SELECT conv_id, turn, b AS t, max(sim) AS best FROM hits GROUP BY ALL) USING (conv_id, turn, t) GROUP BY ALL),
soft AS (SELECT conv_id, turn, CASE WHEN coalesce(p, 0) + coalesce(rec, 0) > 0 THEN 2 * p * rec / (p + rec) ELSE 0 END AS soft_match
  FROM tok LEFT JOIN pr USING (conv_id, turn) LEFT JOIN rc USING (conv_id, turn))"""
_VECTOR = "[1.0, " + ", ".join(f"CAST(length(t) - length(replace(t, '{c}', '')) AS double)" for c in "etanio") + "]"


def _everything(by: str) -> str:
    """CTE ``report`` with every metric per group, unrounded."""
    return f"""{_tokenized(words)}, {_GRAMS}, {_LCS}, {_SOFT},
sums AS (SELECT {by}, count(*) AS pairs, avg(hl) AS length, 100 * avg({_F1}) AS f1, 100 * avg({_ROUGE}) AS rouge_l,
    100 * avg(soft_match) AS soft_match, {_SUMS}
  FROM per_row JOIN lengths USING (conv_id, turn) JOIN soft USING (conv_id, turn) GROUP BY {by}),
shares AS (SELECT {by}, 100.0 * count(DISTINCT CASE WHEN n = 1 THEN g END) / greatest(count_if(n = 1), 1) AS distinct_1,
    100.0 * count(DISTINCT CASE WHEN n = 2 THEN g END) / greatest(count_if(n = 2), 1) AS distinct_2
  FROM tok LEFT JOIN (SELECT * FROM gram WHERE side = 'h') USING (conv_id, turn) GROUP BY {by}),
report AS (SELECT {by}, pairs, length, distinct_1, distinct_2, 100 * ({_bleu_sql(1)}) AS bleu_1, 100 * ({_bleu_sql(2)}) AS bleu_2,
  f1, rouge_l, soft_match FROM sums JOIN shares USING ({by}))"""


_SUMMARY = """round_even(bleu_1, 2) AS "bleu-1", round_even(bleu_2, 2) AS "bleu-2", round_even(rouge_l, 2) AS "rouge-l",
  round_even(distinct_1, 2) AS "distinct-1", round_even(distinct_2, 2) AS "distinct-2", round_even(soft_match, 2) AS soft_match"""
_ABLATED = _everything("variant").replace(
    "classifier, ", "classifier, CASE conv_id % 3 WHEN 0 THEN 'llm_only' WHEN 1 THEN 'strategy_probability' ELSE 'stage_information' END AS variant, ", 1
)
_GROUPED = f"{_tokenized(words)}, {_GRAMS}"

ORACLES = {
    "bleu": f"""WITH {_GROUPED}, sums AS (SELECT llm_alias, classifier, {_SUMS} FROM per_row GROUP BY ALL)
SELECT *, {", ".join(f"round(100 * ({_bleu_sql(k)}), 6) AS bleu_{k}" for k in (1, 2, 3, 4))} FROM sums""",
    "bleu_punctuation": f"""WITH {_tokenized(punct)}, {_GRAMS}, sums AS (SELECT {_SUMS} FROM per_row)
SELECT *, {", ".join(f"round(100 * ({_bleu_sql(k)}), 6) AS bleu_{k}" for k in (1, 2))} FROM sums""",
    "distinct_k": f"""WITH {_GROUPED} SELECT llm_alias, classifier,
  {", ".join(f"round(count(DISTINCT CASE WHEN n = {k} THEN g END) / greatest(count_if(n = {k}), 1), 6) AS distinct_{k}" for k in (1, 2))}
FROM tok JOIN gram USING (conv_id, turn) WHERE side = 'h' GROUP BY ALL""",
    "unigram_f1": f"WITH {_GROUPED} SELECT conv_id, turn, CAST(m1 AS bigint) AS m1, round({_F1}, 6) AS f1 FROM per_row",
    "lcs": f"WITH {_tokenized(words)}, {_LCS} SELECT conv_id, turn, lcs FROM lengths",
    "rouge_l": f"""WITH {_tokenized(words)}, {_LCS}
SELECT llm_alias, classifier, round(100 * avg({_ROUGE}), 6) AS rouge_l FROM tok JOIN lengths USING (conv_id, turn) GROUP BY ALL""",
    "soft_match_f1": f"WITH {_tokenized(words)}, {_SOFT} SELECT conv_id, turn, round(soft_match, 6) AS soft_match FROM soft",
    "soft_match_vectors": f"""WITH {_tokenized(words)},
hu AS (SELECT conv_id, turn, t, count(*) AS k, {_VECTOR} AS v FROM (SELECT conv_id, turn, unnest(h) AS t FROM tok) GROUP BY ALL),
ru AS (SELECT conv_id, turn, t, count(*) AS k, {_VECTOR} AS v FROM (SELECT conv_id, turn, unnest(r) AS t FROM tok) GROUP BY ALL),
sims AS (SELECT hu.conv_id, hu.turn, hu.t AS a, ru.t AS b, hu.k AS ka, ru.k AS kb, list_cosine_similarity(hu.v, ru.v) AS sim
  FROM hu JOIN ru USING (conv_id, turn)),
pr AS (SELECT conv_id, turn, sum(best * k) / sum(k) AS p FROM (SELECT conv_id, turn, a, any_value(ka) AS k, max(sim) AS best FROM sims GROUP BY conv_id, turn, a) GROUP BY ALL),
rc AS (SELECT conv_id, turn, sum(best * k) / sum(k) AS rec FROM (SELECT conv_id, turn, b, any_value(kb) AS k, max(sim) AS best FROM sims GROUP BY conv_id, turn, b) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN p + rec > 0 THEN 2 * p * rec / (p + rec) ELSE 0 END, 6) AS soft_match FROM pr JOIN rc USING (conv_id, turn)""",
    "generation_quality": f"""WITH {_everything('llm_alias, classifier')}
SELECT llm_alias, classifier, pairs, {", ".join(f"round({c}, 6) AS {c}" for c in ("length", "distinct_1", "distinct_2", "bleu_1", "bleu_2", "f1", "rouge_l", "soft_match"))} FROM report""",
    "generation_quality_summary": f"WITH {_everything('llm_alias, classifier')} SELECT llm_alias, classifier AS model, {_SUMMARY} FROM report",
    "ablation_summary": f"WITH {_ABLATED} SELECT variant AS model, {_SUMMARY} FROM report",
    "leaderboard": f"""WITH {_everything('llm_alias')}, {LABELLED},
votes AS (SELECT 'm' || (conv_id % 3) AS model, strategy_true, strategy_pred FROM pred
  UNION ALL SELECT 'labels only', stage_true, stage_pred FROM pred), {f1_sql('votes', 'model', 'strategy_true', 'strategy_pred')}
SELECT f1s.model, {", ".join(f"coalesce(format('{{:.2f}}', report.{c}), '-') AS \"{n}\"" for n, c in (("B-1", "bleu_1"), ("B-2", "bleu_2"), ("R-L", "rouge_l"), ("D-1", "distinct_1"), ("D-2", "distinct_2"), ("soft_match", "soft_match")))},
  format('{{:.4f}}', macro_f1) AS "macro-F1", format('{{:.4f}}', weighted_f1) AS "weighted-F1" FROM f1s LEFT JOIN report ON f1s.model = report.llm_alias""",
    "missing_results": f"""WITH {PAIRS}, g(llm_alias) AS (VALUES ('m0'), ('m1'), ('m2'), ('m3')),
c(classifier) AS (VALUES ('c0'), ('c1'), ('distilbert'), ('roberta'))
SELECT llm_alias, classifier, llm_alias || '/' || classifier || ': missing or empty' AS warning FROM g, c
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.llm_alias = g.llm_alias AND p.classifier = c.classifier)""",
}

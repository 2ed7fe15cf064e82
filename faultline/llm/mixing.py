"""Mixing sources to target weights: iterative proportional fitting of token
weights to source, language and topic marginals, then sampling by the calibrated
probabilities.

Documents are reduced to cells (source, language, topic); raking runs on the cells
only.  A document's inclusion probability is min(1, factor x weight / tokens) of
its cell, with the factor set so that the expected tokens meet the budget, and a
hash of its id decides, so every rerun draws the same sample.

DataFrame functions only.  Defined cases: a null source or language is the
category ""; null and wordless texts have no tokens and count as one, so that
they can be drawn; rows with one doc_id share their draw; a null doc_id draws by
its text.  Columns beside doc_id, text, source and lang are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import broadcast_checked, fresh, written

DIMS = ("source", "lang", "topic")
#: A category's target share is its token share to this power, normalised.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS, FACTOR_ROUNDS = 10, 6
BUDGET = 0.5
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[%$&*#|@{}<>=+~^]"


def n_tokens(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)), F.lit(1)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic from the text's form: symbols, numbers, brief, article or long."""
    size = F.greatest(F.char_length(text), F.lit(1))
    return (F.when(F.regexp_count(text, F.lit(SYMBOLS)) * 50 >= size, "symbols")
            .when(F.regexp_count(text, F.lit("[0-9]")) * 20 >= size, "numbers")
            .when(tokens < 100, "brief").when(tokens < 1000, "article").otherwise("long"))


def rake(cells: DataFrame, temper: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, summing to 1, whose
    marginals are raked to the targets."""
    temper = TEMPER if temper is None else temper
    total = F.col("tokens").cast("double")
    c = cells.withColumn("weight", total)
    for d in DIMS:
        goal = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper[d])).alias(f"goal_{d}"))
        scale = goal.agg(F.sum(f"goal_{d}")).first()[0] or 1.0
        c = c.join(goal.withColumn(f"goal_{d}", F.col(f"goal_{d}") / scale), d)
    c = written(c, "mix-goals")
    for i in range(rounds):
        for d in DIMS:
            c = c.withColumn("weight", F.col("weight") * F.col(f"goal_{d}") / F.sum("weight").over(Window.partitionBy(d)))
        if i % 2:
            c = written(c, "mix-rake")
    whole = c.agg(F.sum("weight")).first()[0] or 1.0
    return c.withColumn("weight", F.col("weight") / whole)


def mix(docs: DataFrame, budget: float = BUDGET, temper: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with ``_mix``: n_tokens, topic, probability and sampled (an input
    column of that name is replaced)."""
    n, p_name, *dims = fresh(docs, "_n", "_p", *[f"_mix_{d}" for d in DIMS])
    base = docs.withColumn(n, n_tokens(F.col("text")))
    base = base.withColumn(dims[0], F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn(
        dims[1], F.coalesce(F.col("lang").cast("string"), F.lit(""))).withColumn(dims[2], topic_of(F.col("text"), F.col(n)))
    cells = base.groupBy(*[F.col(c).alias(d) for c, d in zip(dims, DIMS)]).agg(F.sum(n).alias("tokens"))
    cells = written(rake(written(cells, "mix-cells"), temper), "mix-weights")
    want = budget * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factor = want
    for _ in range(FACTOR_ROUNDS):  # tokens that full cells cannot give go to the others
        got = cells.agg(F.sum(F.least(F.col("tokens").cast("double"), F.lit(factor) * F.col("weight")))).first()[0]
        factor = factor * want / got if got else factor
    p = F.round(F.least(F.lit(1.0), F.lit(factor) * F.col("weight") / F.col("tokens")), 6)
    cells = broadcast_checked(written(cells.select(*[F.col(d).alias(c) for c, d in zip(dims, DIMS)], p.alias(p_name)), "mix-p"), 128)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(16**12)
    m = F.struct(F.col(n).alias("n_tokens"), F.col(dims[2]).alias("topic"), F.col(p_name).alias("probability"), (draw < F.col(p_name)).alias("sampled"))
    return base.join(cells, dims).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "_mix"], m.alias("_mix"))

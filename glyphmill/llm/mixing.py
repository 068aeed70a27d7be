"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, discard, prepare, stash, unused

LEAF, FAN = 1 << 14, 64
ONE, TINY = 1 - 1e-9, 1e-9


def uniform(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that follows from its arguments alone."""
    z = (seed * 0x9E3779B97F4A7C15 ^ (a & (1 << 64) - 1) * 0xBF58476D1CE4E5B9 ^ (b & (1 << 64) - 1) * 0x94D049BB133111EB) & (1 << 64) - 1
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ z >> s) * m) & (1 << 64) - 1
    return (z ^ z >> 31) / 2**64


def pivotal(ids: list[int], p: list[float], seed: int) -> tuple[list[int], int, float]:
    """Round the probabilities: which ids got 1, and the unit that stays fractional.

    Two fractional units meet; at random, with unchanged expectations, mass moves
    until one of them is 0 or 1, and the other one goes on. Without a rest its
    probability is 0.
    """
    won = []
    a, pa_ = -1, 0.0
    for b, pb in zip(ids, p):
        if pa_ <= TINY:
            a, pa_ = b, pb
            continue
        s, u = pa_ + pb, uniform(seed, a, b)
        if s < ONE:
            if u * s >= pa_:  # b takes all the mass
                a = b
            pa_ = s
        elif s <= 1 + TINY:
            won.append(a if u < pa_ / s else b)
            pa_ = 0.0
        else:
            if u * (2 - s) < 1 - pb:  # a is taken
                won.append(a)
                a = b
            else:
                won.append(b)
            pa_ = s - 1
        if pa_ >= ONE:
            won.append(a)
            pa_ = 0.0
    return won, a, pa_


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, expected, copies)`` of every row with an id.

    A source's mass is the characters of all its texts. ``weights`` are the
    shares of ``budget`` (by default the whole mass); without them a source's
    share goes with its mass to the power ``temperature``. Every document of a
    source is expected ``share * budget / mass`` times: it gets the whole part,
    and the fractional parts are rounded by the pivotal method, so a source's
    copies differ from their expectation by less than 1, and each document's
    copies from its own.

    The fractional units of a source are cut into leaves by a hash of the id
    (about 16,384 each), rounded there, and what stays fractional goes up a
    reduction tree of fan 64; the last unit of a source is drawn. All
    draws follow from ids and seed: a repeated task decides alike.

    Sources that ``weights`` doesn't name, or with weight 0, get 0 copies; a null
    source is a source of its own, named by null in ``weights`` too. A source
    whose texts are all empty is expected once each. Rows of the same id and
    source are one document with one decision, and every one of them is
    returned. Null ids are left out; an empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.coalesce(F.length(docs[text_col]), F.lit(0)).cast("double").alias("size"))
    mass = rows.groupBy("source").agg(F.sum("size").alias("mass"), F.count("*").alias("n"))
    if weights is not None:
        table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "name string, w double")
        mass = mass.join(F.broadcast(table), mass["source"].eqNullSafe(table["name"]), "left").drop("name").withColumn("w", F.coalesce("w", F.lit(0.0)))
    else:
        mass = mass.withColumn("w", F.pow("mass", F.lit(float(temperature))))
    total = mass.agg(F.sum("w").alias("all_w"), F.sum("mass").alias("all_mass"))
    whole = F.lit(float(budget)) if budget is not None else F.col("all_mass")
    rate = mass.crossJoin(F.broadcast(total)).select(
        F.col("source").alias("of"),
        F.round(F.when(F.col("w") <= 0, F.when((F.lit(weights is None)) & (F.col("mass") == 0), 1.0).otherwise(0.0)).when(F.col("mass") == 0, 1.0).otherwise(F.col("w") / F.col("all_w") * whole / F.col("mass")), 9).alias("expected"),
        "n",
    )
    # sources are few, but nothing bounds them: Spark broadcasts the rates only below its own threshold
    ids = rows.select("doc_id", "source")
    units = ids.join(rate, ids["source"].eqNullSafe(rate["of"])).select("doc_id", "source", "expected", "n", (F.col("expected") - F.floor("expected")).alias("p"))
    key = F.xxhash64(F.col("source"), F.lit(seed))
    split = F.greatest(F.lit(1), F.ceil(F.col("n") / LEAF)).cast("long")
    leaves = units.filter((F.col("p") > TINY) & (F.col("p") < ONE)).select(
        "doc_id", "p", key.alias("k"), F.when(F.col("source").isNull(), 1).otherwise(0).alias("none"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), split).alias("leaf"),
    ).distinct()  # one id may stand in any number of rows; they don't fill a leaf

    def reduce(df: DataFrame) -> DataFrame:
        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            doc, p, k, none, leaf = (t.column(c).to_numpy() for c in ("doc_id", "p", "k", "none", "leaf"))
            cut = np.flatnonzero((k[1:] != k[:-1]) | (none[1:] != none[:-1]) | (leaf[1:] != leaf[:-1])) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cut], [*cut, len(k)]):
                own, at = np.unique(doc[a:b], return_index=True)  # rows of one id are one unit
                order = np.argsort([uniform(seed, int(x), 1) for x in own], kind="stable")
                won, rest, q = pivotal(own[order].tolist(), p[a:b][at][order].tolist(), seed)
                out += [(int(k[a]), int(none[a]), int(leaf[a]), x, 1.0) for x in won]
                if q > TINY:
                    out.append((int(k[a]), int(none[a]), int(leaf[a]), rest, q))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["k", "none", "leaf", "doc_id", "p"])

        return by_group(df, ["k", "none", "leaf"], run, "k long, none int, leaf long, doc_id long, p double", most=1 << 14, order=["doc_id"])

    done = stash(reduce(leaves), "mix-leaves")
    won, rest = done.filter("p = 1.0"), done.filter("p < 1.0")
    while True:
        top = rest.agg(F.max("leaf")).first()[0]
        if not top:
            break
        done = stash(reduce(rest.withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("long"))), "mix-level")
        won, rest = won.unionByName(done.filter("p = 1.0")), done.filter("p < 1.0")
    last = rest.filter(F.pmod(F.xxhash64("k", "doc_id", F.lit(seed)), F.lit(1 << 30)) < F.col("p") * (1 << 30))
    taken = won.unionByName(last).select(F.col("k").alias("tk"), F.col("none").alias("tn"), F.col("doc_id").alias("td"), F.lit(1).alias("extra"))
    on = (units["doc_id"] == taken["td"]) & (key == taken["tk"]) & (F.when(units["source"].isNull(), 1).otherwise(0) == taken["tn"])
    whole_part = F.when(F.col("p") >= ONE, F.floor("expected") + 1).otherwise(F.floor("expected"))
    return units.join(taken, on, "left").select("doc_id", "source", "expected", (whole_part + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that :func:`mix_sources` takes, with all their columns and ``copies``.

    A column ``copies`` that the documents have is replaced; others may have any name. Rows with a null id
    can't be drawn: they stay, once each. Null and empty texts, null sources, repeated rows and empty tables are as in
    :func:`mix_sources`.
    """
    own = docs.drop("copies")
    qd, qs, qn = unused(own, "drawn_id", "drawn_source", "drawn_copies")
    got = mix_sources(docs, weights, temperature, budget, seed, id_col, text_col, source_col).select(F.col("doc_id").alias(qd), F.col("source").alias(qs), F.col("copies").alias(qn)).distinct()
    on = (own[id_col].cast("long") == got[qd]) & own[source_col].cast("string").eqNullSafe(got[qs])
    out = own.join(got.hint("merge"), on, "left").withColumn("copies", F.when(own[id_col].isNull(), F.lit(1)).otherwise(F.col(qn)).cast("long"))
    return out.drop(qd, qs, qn).filter("copies > 0")

"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies are its weight times a factor of its source, `most` at the largest; the factor makes the expected
words of a source its target. Of f expected copies floor(f) are certain, and one more has the inclusion probability
p = f - floor(f). For that one, documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and
taken in that order until the source's remaining words are used up: a sample of unequal probabilities whose size is fixed in
words. A document that no longer fits is passed over for later ones that do, until what is open is at most NEAR of
the target or no document fits; then the one document that brings the source nearest to its target may close the gap.

DataFrame functions only. All that is decided about a source are a few places in its order and the room left behind each, so
copies follow from a row and its source alone: documents are neither sorted nor shuffled. The places are found from sums by slice (as
many slices as a slice has documents, about the root of the source's), and only slices that hold a place are sorted.

Defined cases. Null text: size 0. Null source: a source of its own, last. Null doc_id: takes part; random numbers depend on id
and text. Rows that repeat id, text and source count separately; if only some of them are taken, which ones makes no
difference. Empty table: empty result. A source without words has target 0. Null or negative weights count as 0; documents of weight 0
are taken last. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, cut, forget, numbered

#: What may stay open of a target; sources up to which their decisions are broadcast (about 100 bytes each), beyond that they are joined by a shuffle.
NEAR, FEW_SOURCES = 0.001, 50_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size): with target double.

    Sources by code point, null last, take the weights in turn and share budget * all sizes; a target stops at most *
    its size, and the excess is shared by weight among the others until none is above. That is a water level: target =
    min(stop, w * level). The level rises from the one nobody stops at, each time to where the stopped ones leave it, until no
    more stop; each step is a sum over sources."""
    df = numbered(sizes.select("source", "source_size"), F.col("source").asc_nulls_last(), name="turn")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    df = cut(df.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(most)).alias("stop")), "weights")
    every = df.agg(F.sum("source_size")).first()[0]
    level, before = -1.0, None
    while level != before:
        before, under = level, F.col("w") * level < F.col("stop")
        gone, left = df.agg(F.sum(F.when(~under, F.col("stop")).otherwise(0.0)), F.sum(F.when(under, F.col("w")).otherwise(0.0))).first()
        if not left:  # all stop, or there is no source
            level = float("inf")
            break
        level = max(before, (every * budget - gone) / left)
    return df.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("stop", F.col("w") * level)).alias("target"))


def _facts(docs: DataFrame, seed: int, doc_weight: Column | None, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What decides on a row: source, size in words, random number, weight."""
    text = F.col(f"`{text_col}`")
    h = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.xxhash64(text))
    wanted = F.lit(1.0)
    if doc_weight is not None:
        w = doc_weight.cast("double")
        wanted = F.when((w > 0) & (w < float("inf")), F.pow(F.lit(2.0), F.round(F.log2(F.nullif(w, F.lit(0.0))) * 64) / 64)).otherwise(0.0)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col(f"`{source_col}`").alias("source"), size.alias("size"), ((h.bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)).alias("u"), wanted.alias("wanted")]


def _by_source(df: DataFrame, per: DataFrame, few: bool) -> DataFrame:
    """df joined with the one row of its source; broadcast if there are FEW_SOURCES at most."""
    per = per.withColumnRenamed("source", "__source")
    return df.join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _expected(most: int) -> tuple[Column, Column]:
    """Certain copies, and the place t in the order of a further one: 0 to 1, the odds' ratio mapped; above 1 without a chance; null at `most`."""
    mean = F.when(F.col("target") >= F.col("source_size") * float(most), F.lit(float(most))).otherwise(F.least(F.col("wanted") * F.col("factor"), F.lit(float(most))))
    sure, p = F.floor(mean), mean - F.floor(mean)
    odds = F.col("u") / (1 - F.col("u")) * (1 - p) / F.nullif(p, F.lit(0.0))
    t = F.when(sure >= most, F.lit(None).cast("double")).when(p > 0, odds / (1 + odds)).otherwise(F.lit(1.0) + F.col("u"))
    return sure.cast("long"), t


def _factors(rows: DataFrame, per: DataFrame, few: bool, most: int) -> DataFrame:
    """per with the factor that makes sum(size * min(wanted * factor, most)) the target, with all of the larger weights at `most`.

    Weights are rounded to powers of 2^(1/64), so a source's different weights, which are put in order, are bounded in number."""
    if "mass" not in per.columns:  # all weights are 1
        return per.withColumn("factor", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    sums = rows.where("size > 0 and wanted > 0").groupBy("source", "wanted").agg(F.sum("size").alias("words"))
    sums = _by_source(sums, per.select("source", "target", "mass"), few)
    down = Window.partitionBy("source").orderBy(F.desc("wanted")).rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("words").over(down), F.lit(0))
    rest = F.col("mass") - F.coalesce(F.sum(F.col("words") * F.col("wanted")).over(down), F.lit(0.0))
    # The factor if just the weights above this one are at `most`: right for the largest weight that it leaves below.
    sums = sums.select("source", "wanted", ((F.col("target") - most * full) / F.greatest(rest, F.lit(1e-9))).alias("factor"))
    best = sums.where(F.col("wanted") * F.col("factor") <= most).groupBy("source").agg(F.max(F.struct("wanted", "factor"))["factor"].alias("factor")).withColumnRenamed("source", "s")
    return per.join(best, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("factor", F.coalesce("factor", F.when(F.col("mass") > 0, 1e300).otherwise(0.0)))  # all at `most` don't reach the target


def _places(rows: DataFrame, per: DataFrame, few: bool, most: int) -> DataFrame:
    """per with steps, an array of (t, room): behind place t of a source's order what fits in `room` words is taken up to the next step,
    and the document at t is passed over; and picks, an array of (t, n, rows): n of the rows at t are taken all the same."""
    sure, t = _expected(most)
    facts = ["source", "size", "wanted", "u"]
    df = _by_source(rows.select(*facts), per.select("source", "source_size", "target", "factor", "docs"), few)
    df = df.where("size > 0").select("source", "size", sure.alias("sure"), t.alias("t"), "docs")
    certain = df.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("certain"))
    kinds = "array<struct<t:double,room:double>>", "array<struct<t:double,n:long,rows:long>>"
    state = per.join(certain.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    room = F.greatest(F.col("target") - F.coalesce("certain", F.lit(0)), F.lit(0.0))
    state = cut(state.select(*per.columns, F.array(F.struct(F.lit(-1.0).alias("t"), room.alias("room"))).cast(kinds[0]).alias("steps"), F.array().cast(kinds[1]).alias("picks"), room.alias("gap"), F.lit(True).alias("open")), "places")
    df = cut(df.where("t is not null").select("source", "size", "t", F.floor(F.col("t") / 2 * F.ceil(F.sqrt("docs"))).alias("slice")), "order")

    names = [*per.columns, "steps", "picks"]
    while True:
        last = F.element_at("steps", -1)
        now = state.where("open").select("source", last["t"].alias("at"), last["room"].alias("room"))
        # Where does the running sum of what still fits exceed the room? First by slices, then within that slice.
        left = _by_source(df, now, few).where((F.col("t") > F.col("at")) & (F.col("size") <= F.col("room")))
        sums = left.groupBy("source", "slice", "room").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("upto", upto)
        cross = sums.where(F.col("upto") > F.col("room")).groupBy("source").agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("x")).select(F.col("source").alias("s"), F.col("x.slice").alias("k"), "x.before")
        ties = left.join(cross, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k"))).groupBy("source", "t", "room", "before").agg(F.count("*").alias("rows"), F.sum("size").alias("words"), F.max("size").alias("one"))
        inner = F.sum("words").over(Window.partitionBy("source").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ties = ties.withColumn("upto", F.col("before") + inner).where(F.col("upto") > F.col("room"))
        hit = ties.groupBy("source").agg(F.min(F.struct("t", (F.col("upto") - F.col("words")).alias("before"), "rows", "one")).alias("h"))
        total = sums.groupBy("source").agg(F.sum("words").alias("all"))
        news = now.join(total.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")), "left").join(hit.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
        n = F.floor((F.col("room") - F.col("h.before")) / F.col("h.one"))  # of equal rows some may still fit
        news = news.select(F.col("source").alias("s"), F.col("h.t").alias("t"), n.alias("n"), F.col("h.rows").alias("rows"), F.when(F.col("h").isNull(), F.col("room") - F.coalesce("all", F.lit(0))).otherwise(F.col("room") - F.col("h.before") - n * F.col("h.one")).alias("rest"))
        both = state.join(news, F.col("open") & F.col("source").eqNullSafe(F.col("s")), "left")
        more = F.col("open") & F.col("t").isNotNull() & (F.col("rest") > F.col("target") * NEAR)
        fresh = F.when(F.col("t").isNotNull(), F.array(F.struct("t", F.when(more, F.col("rest")).otherwise(0.0).alias("room"))).cast(kinds[0])).otherwise(F.array().cast(kinds[0]))
        pick = F.when(F.col("n") > 0, F.array(F.struct("t", "n", "rows")).cast(kinds[1])).otherwise(F.array().cast(kinds[1]))
        state = cut(both.select(*per.columns, F.concat("steps", fresh).alias("steps"), F.concat("picks", pick).alias("picks"), F.coalesce("rest", "gap").alias("gap"), F.coalesce(more, F.lit(False)).alias("open")), "places", (state,))
        if not state.where("open").limit(1).count():
            break

    # The one document that comes nearest, where more than NEAR is open.
    now = state.where(F.col("gap") > F.col("target") * NEAR).select("source", "gap", "steps", "picks")
    left = _by_source(df, now, few).where(~_taken(F.col("t")) & ~F.exists("picks", lambda x: x["t"] == F.col("t")) & (F.col("size") < 2 * F.col("gap")))
    best = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "t")).alias("b"))
    best = best.select("source", F.col("b.t").alias("best"))
    equal = _by_source(df, best, few).where("t = best").groupBy("source").agg(F.first("t").alias("t"), F.count("*").alias("rows")).withColumnRenamed("source", "s")
    both = state.join(equal, F.col("source").eqNullSafe(F.col("s")), "left")
    pick = F.when(F.col("rows").isNotNull(), F.array(F.struct("t", F.lit(1).cast("long").alias("n"), "rows")).cast(kinds[1])).otherwise(F.array().cast(kinds[1]))
    done = cut(both.select(*per.columns, "steps", F.concat("picks", pick).alias("picks")), "places", (state,))
    forget(df)
    return done.select(*names)


def _taken(t: Column) -> Column:
    """Is a row of place t and size `size` taken by its source's steps? Null t: no."""
    behind = F.try_element_at(F.filter("steps", lambda x: x["t"] < t), F.lit(-1))
    return F.coalesce(~F.exists("steps", lambda x: x["t"] == t) & (F.col("size") > 0) & (F.col("size") <= behind["room"]), F.lit(False))


def _plan(docs: DataFrame, weights, budget, most, seed, doc_weight, id_col, text_col, source_col) -> tuple[DataFrame, DataFrame, bool]:
    """Compact rows (doc_id, source, size, u, wanted), decisions by source, and whether the latter are few."""
    rows = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_facts(docs, seed, doc_weight, id_col, text_col, source_col)), "sizes")
    mass = [] if doc_weight is None else [F.sum(F.col("size") * F.col("wanted")).alias("mass")]
    per = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), *mass), "sources")
    few = per.count() <= FEW_SOURCES
    aims = targets(per.select("source", "source_size"), weights, budget, float(most)).select(F.col("source").alias("s"), "target")
    per = per.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return rows, _places(rows, _factors(rows, per, few, most), few, most), few


def _with_copies(df: DataFrame, per: DataFrame, few: bool, most: int) -> DataFrame:
    """df (source, size, u, wanted, ...) with source_size, target and copies."""
    sure, t = _expected(most)
    df = _by_source(df, per.select("source", "source_size", "target", "factor", "steps", "picks"), few)
    none = F.lit(None).cast("struct<t:double,n:long,rows:long>")
    fact = F.struct(F.when(F.col("size") > 0, sure).otherwise(0).alias("sure"), t.alias("t"))
    # The lambda's variable holds sure and t, so they are worked out once.
    said = F.transform(F.array(fact), lambda x: F.struct(x["sure"].alias("sure"), _taken(x["t"]).cast("long").alias("extra"), F.coalesce(F.get(F.filter("picks", lambda y: (y["t"] == x["t"]) & (F.col("size") > 0)), F.lit(0)), none).alias("pick")))
    df = df.withColumn("said", F.get(said, F.lit(0))).drop("steps", "picks", "factor")
    whole = F.coalesce(F.col("said.pick.n") >= F.col("said.pick.rows"), F.lit(False))
    some = F.coalesce(F.col("said.pick.n") < F.col("said.pick.rows"), F.lit(False))
    gone = ["said", "u", "wanted"]
    out = df.withColumn("copies", (F.col("said.sure") + F.greatest("said.extra", whole.cast("long"))).cast("int"))
    if not per.where(F.exists("picks", lambda x: x["n"] < x["rows"])).limit(1).count():
        return out.drop(*gone)
    # Of equal rows only some: they are numbered by partition, so a group of any size is spread.
    equal = cut(df.where(some).withColumn("__id", F.monotonically_increasing_id()), "equal").withColumn("part", F.shiftright("__id", 33)).withColumn("t", F.col("said.pick.t"))
    sizes = equal.groupBy(F.col("source").alias("s"), F.col("t").alias("st"), F.col("part").alias("sp")).agg(F.count("*").alias("c"))
    sizes = sizes.withColumn("ahead", F.sum("c").over(Window.partitionBy("s", "st").orderBy("sp")) - F.col("c"))
    nth = F.row_number().over(Window.partitionBy("source", "t", "part").orderBy("__id"))
    equal = equal.withColumn("nth", nth).join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("t") == F.col("st")) & (F.col("part") == F.col("sp")))
    equal = equal.withColumn("copies", (F.col("said.sure") + (F.col("ahead") + F.col("nth") <= F.col("said.pick.n")).cast("long")).cast("int"))
    return out.where(~some).drop(*gone).unionByName(equal.select(*[c for c in out.columns if c not in gone]))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: int = 2, seed: int = 17, doc_weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies (0 to `most`), taken = copies * size.

    doc_weight: relative expected copies within a source; by default all alike. Reruns agree."""
    rows, per, few = _plan(docs, weights, budget, most, seed, doc_weight, id_col, text_col, source_col)
    out = _with_copies(rows, per, few, most)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: int = 2, seed: int = 17, doc_weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it; all columns, in their order. With FEW_SOURCES at most, texts
    aren't shuffled, but for equal rows of which only some are taken."""
    rows, per, few = _plan(docs, weights, budget, most, seed, doc_weight, id_col, text_col, source_col)
    forget(rows)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_facts(docs, seed, doc_weight, id_col, text_col, source_col))
    both = _with_copies(whole, per, few, most).where("copies > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

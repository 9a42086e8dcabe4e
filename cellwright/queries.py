"""Queries of the repair engine's own operators over whole tables, with the SQL that gives the same rows.

Most work on `part`, where name and size should determine the brand; row numbers are the keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import text
from .operators import detect, evaluate, features, model, repair, wrangle
from .operators import domain as dom
from .plans.constraint import ConstraintError, parse
from .sources import tables
from .sources.scratch import cut, new_folder

ATTRS = ["p_name", "p_brand", "p_type", "p_size"]
DIRTY = ["p_name", "p_brand", "p_size"]
RULE = "t1&t2&EQ(t1.p_name,t2.p_name)&EQ(t1.p_size,t2.p_size)&IQ(t1.p_brand,t2.p_brand)"
#: Given weights, so that inference can be compared with SQL.
WEIGHTS = {"Init": 1.5, "DC1": -0.4, "DC2": -0.6, "DC3": -0.3, "DC4": -0.5, "DC5": -0.8, "DC6": -0.7, "Cooccur:p_name": 0.9, "Cooccur:p_brand": 0.7, "Cooccur:p_size": 1.1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("__ind"), *ATTRS)


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with every seventh segment and every eleventh name missing."""
    df = table(spark, sf_dir, "customer")
    hole = lambda c, n: F.when(F.col("c_custkey") % n != 0, F.col(c)).alias(c)
    return df.select(F.col("c_custkey").alias("__ind"), hole("c_name", 11), "c_nationkey", hole("c_mktsegment", 7))


def rule(text_: str, df: DataFrame):
    return parse(text_, df.columns)


def _cells(df: DataFrame) -> DataFrame:
    return df.select("ind", "attr")


def dc_dk_cells(spark, d):
    df = part(spark, d)
    return detect.ConstraintDetector([rule(RULE, df)]).noisy_cells(df)


def dc_clean_cells(spark, d):
    df = part(spark, d)
    return detect.ConstraintDetector([rule(RULE, df)]).clean_cells(df)


def dc_dependency(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("__ind"), "l_orderkey", "l_linenumber", "l_returnflag")
    return detect.ConstraintDetector([rule("t1&t2&EQ(t1.l_orderkey,t2.l_orderkey)&EQ(t1.l_linenumber,t2.l_linenumber)&IQ(t1.l_returnflag,t2.l_returnflag)", df)]).noisy_cells(df)


def dc_theta(spark, d):
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("__ind"), "s_nationkey", "s_acctbal")
    return detect.ConstraintDetector([rule("a&b&LT(a.s_nationkey,b.s_nationkey)&GTE(a.s_acctbal,b.s_acctbal)", df)]).noisy_cells(df)


def dc_equi(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("__ind"), "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return detect.ConstraintDetector([rule("a&b&EQ(a.o_custkey,b.o_custkey)&GT(a.o_totalprice,b.o_totalprice)&LTE(a.o_orderstatus,b.o_orderstatus)", df)]).noisy_cells(df)


def dc_single(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("__ind"), "o_orderstatus", "o_orderpriority")
    return detect.ConstraintDetector([rule("t1&EQ(t1.o_orderstatus,'F')&IQ(t1.o_orderpriority,\"1-URGENT\")", df)]).noisy_cells(df)


def dc_literal(spark, d):
    df = table(spark, d, "part").select(F.col("p_partkey").alias("__ind"), "p_name", "p_brand", "p_size")
    return detect.ConstraintDetector([rule("t1&t2&EQ(t1.p_brand,'Brand#11')&EQ(t2.p_brand,'Brand#22')&EQ(t1.p_name,t2.p_name)", df)]).noisy_cells(df)


def dc_three_tuple(spark, d):
    df = table(spark, d, "nation").select(F.col("n_nationkey").alias("__ind"), "n_name", "n_regionkey")
    return detect.ConstraintDetector([rule("a&b&c&EQ(a.n_regionkey,b.n_regionkey)&EQ(b.n_regionkey,c.n_regionkey)&LT(a.n_name,b.n_name)&LT(b.n_name,c.n_name)", df)]).noisy_cells(df)


def dc_union(spark, d):
    """Two constraints whose suspect cells overlap."""
    df = part(spark, d)
    return detect.ConstraintDetector([rule(RULE, df), rule("t1&t2&EQ(t1.p_brand,'Brand#11')&EQ(t2.p_brand,'Brand#22')&EQ(t1.p_name,t2.p_name)", df), rule("t1&GT(t1.p_type,'T')", df)]).noisy_cells(df)


def null_cells(spark, d):
    return detect.NullDetector().noisy_cells(holes(spark, d))


def regex_cells(spark, d):
    df = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("__ind"), "role", "text")
    return detect.RegexDetector("text", "[0-9]{2}").noisy_cells(df)


def _detectors(df):
    return [detect.ConstraintDetector([rule(RULE, df)]), detect.RegexDetector("p_type", "^(ECONOMY|STANDARD|SMALL)")]


def detector_union(spark, d):
    df = part(spark, d)
    return detect.detect(df, _detectors(df))[1]


def detector_intersect(spark, d):
    df = part(spark, d)
    return detect.detect(df, _detectors(df))[0]


def labelled_cells(spark, d):
    df = part(spark, d)
    given = df.where("p_size > 40").select("__ind", F.lit("p_brand").alias("attr"))
    return detect.LabelledCells(given, clean=True).noisy_cells(df)


def index_rows(spark, d):
    return tables.with_index(table(spark, d, "orders").select("o_orderkey", "o_custkey"), order=["o_orderkey"])


def long_columns(spark, d):
    return tables.without_long_columns(table(spark, d, "conversations"), 40).groupBy("conv_id", "role").agg(F.count("*").alias("n"))


def flat_cells(spark, d):
    return tables.flatten(part(spark, d))


def value_counts(spark, d):
    return dom.value_counts(part(spark, d))


def pair_counts(spark, d):
    return dom.pair_counts(part(spark, d), DIRTY)


def cooccur_lookup(spark, d):
    return _lookup(part(spark, d), 0.05).withColumn("p", F.round("p", 9))


def _lookup(df, least):
    return dom.cooccurrence(dom.pair_counts(df, DIRTY), dom.value_counts(df), least)


def _domain_of(df):
    return dom.dk_domain(df, detect.ConstraintDetector([rule(RULE, df)]).noisy_cells(df), _lookup(df, 0.0), Config())


def _fixed_domain(df):
    """Written once, as every signal reads it."""
    return cut(_domain_of(df), "domain")


def dk_domain(spark, d):
    return _domain_of(part(spark, d))


def domain_sizes(spark, d):
    return dom.domain_sizes(_domain_of(part(spark, d)))


def numbered_domain(spark, d):
    return dom.numbered(_fixed_domain(part(spark, d)), ATTRS)


def dirty_attributes(spark, d):
    df = part(spark, d)
    return spark.createDataFrame([(a,) for a in dom.dirty_attributes(df, dc_dk_cells(spark, d))], "attr string")


def _clean_domain(spark, d, config):
    df = part(spark, d)
    training = tables.whole(tables.cells(df, attrs=DIRTY)).join(dc_dk_cells(spark, d), ["ind", "attr"], "left_anti")
    return df, dom.clean_domain(df, training, _lookup(df, 0.0), config)


def clean_domain_all(spark, d):
    return _clean_domain(spark, d, Config(pruning_clean_breakoff=0))[1]


def clean_domain_sampled(spark, d):
    return _clean_domain(spark, d, Config())[1]


def feature_observed(spark, d):
    df = part(spark, d)
    return features.Observed().features(df, _domain_of(df))


def feature_constraint(spark, d):
    df = part(spark, d)
    return features.Violations([rule(RULE, df)]).features(df, _fixed_domain(df))


def feature_literal(spark, d):
    """A constraint with literals, and one that compares different attributes."""
    df = part(spark, d)
    rules = [rule("t1&t2&EQ(t1.p_brand,'Brand#11')&EQ(t2.p_brand,'Brand#22')&EQ(t1.p_name,t2.p_name)", df), rule("t1&t2&EQ(t1.p_name,t2.p_name)&EQ(t1.p_type,t2.p_brand)", df)]
    return features.Violations(rules).features(df, _swapped(df))


def feature_single(spark, d):
    df = part(spark, d)
    return features.Violations([rule("t1&EQ(t1.p_brand,'Brand#11')&GT(t1.p_type,'M')", df)]).features(df, _swapped(df))


def _swapped(df):
    """A given domain: every third row's own values, and Brand#11 and its type as brand, its brand as type."""
    cells = [("p_name", "p_name", 1), ("p_brand", "p_brand", 1), ("p_type", "p_type", 1), ("p_brand", "p_type", 0), ("p_type", "p_brand", 0)]
    made = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(v).alias("val"), F.lit(o).alias("observed")) for a, v, o in cells], F.struct(F.lit("p_brand").alias("attr"), F.lit("Brand#11 ").alias("val"), F.lit(0).alias("observed"))))
    return df.where("__ind % 3 = 0").select(F.col("__ind").alias("ind"), made.alias("c")).select("ind", "c.attr", "c.val", "c.observed")


def _cooccur(df):
    return features.Cooccurrence(DIRTY, dom.pair_counts(df, DIRTY), dom.value_counts(df))


def feature_cooccur(spark, d):
    df = part(spark, d)
    return _cooccur(df).features(df, _fixed_domain(df)).withColumn("value", F.round("value", 9))


def _signals(df):
    return [features.Observed(), features.Violations([rule(RULE, df)]), _cooccur(df)]


def _normalized(df):
    return features.normalized(features.featurize(df, _fixed_domain(df), _signals(df))).withColumn("value", F.round("value", 7))


def feature_normalized(spark, d):
    return _normalized(part(spark, d))


def feature_map(spark, d):
    return features.feature_map(spark, _signals(part(spark, d)))


def dimensions(spark, d):
    return features.dimensions(clean_domain_all(spark, d), _domain_of(part(spark, d)), len(WEIGHTS))


def _inferred(df):
    spark, domain = df.sparkSession, _fixed_domain(df)
    weights = model.weights_frame(spark, list(WEIGHTS), WEIGHTS.values())
    chances = model.probabilities(domain, features.normalized(features.featurize(df, domain, _signals(df))), weights)
    return chances.withColumn("probability", F.round("probability", 7))


def infer_softmax(spark, d):
    return _inferred(part(spark, d))


def infer_topk(spark, d):
    return model.top(_inferred(part(spark, d)), 2)


def infer_map(spark, d):
    return model.top(_inferred(part(spark, d)), 1).select("ind", "attr", "val")


def _repaired(df):
    return repair.repaired(df, model.top(_inferred(df), 1)).withColumnRenamed("__ind", "ind")


def repaired_fixed(spark, d):
    return _repaired(part(spark, d))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with its brand as name and the brand's maker as brand, every twentieth of them spoilt: names and sizes determine few makers, so
    suspect cells have a choice of candidates at every scale."""
    maker = F.when(F.col("p_partkey") % 20 == 0, F.lit("Brand#9")).otherwise(F.substring("p_brand", 1, 7))
    df = table(spark, sf_dir, "part")
    return df.select(F.col("p_partkey").alias("__ind"), F.col("p_brand").alias("p_name"), maker.alias("p_brand"), "p_type", (F.col("p_size") % 2).alias("p_size"))


def noisy_domain(spark, d):
    return _domain_of(noisy(spark, d))


def noisy_features(spark, d):
    return _normalized(noisy(spark, d))


def noisy_repaired(spark, d):
    return _repaired(noisy(spark, d))


def train_step(spark, d):
    """One step of training on all of the domain as one batch, from given weights."""
    df = noisy(spark, d)
    domain = _fixed_domain(df)
    signals = features.normalized(features.featurize(df, domain, _signals(df)))
    config = Config(learning_iterations=1, batch_size=10**9, learning_rate=0.5, weight_decay=0.1)
    w = model.train(domain, signals, list(WEIGHTS), config, list(WEIGHTS.values()))
    return model.weights_frame(spark, list(WEIGHTS), w).withColumn("weight", F.round("weight", 7))


def _session(spark, df, config=Config()):
    session = repair.Session(spark, config)
    session.use(df)
    return session


def session_repair(spark, d):
    """A whole session with given weights, its constraints from a file, one of them removed again."""
    session = _session(spark, noisy(spark, d))
    path = new_folder(spark, "constraints")
    spark.createDataFrame([(RULE,), ("",), ("t1&EQ(t1.p_brand,'Brand#1')",)], "value string").coalesce(1).write.text(path)
    session.load_denial_constraints(path)
    session.remove_denial_constraint([c.text for c in session.constraints].index("t1&EQ(t1.p_brand,'Brand#1')"))
    session.detect_errors([detect.ConstraintDetector(session.constraints), detect.NullDetector()])
    return session.repair(WEIGHTS).withColumnRenamed("__ind", "ind")


def session_cells(spark, d):
    """Suspect and clean cells from files in place of detection."""
    df = part(spark, d)
    path = new_folder(spark, "cells") + ".csv"
    tables.write_csv(df.where("p_size > 40").select(F.col("__ind").alias("ind"), F.lit("p_brand").alias("attr")), path)
    dirty, clean = _session(spark, df), _session(spark, df)
    dirty.load_dirty_data(path)
    clean.load_clean_data(path)
    return dirty.dk.select("ind", "attr", F.lit("dirty").alias("given")).union(clean.clean.select("ind", "attr", F.lit("clean").alias("given")))


def loaded_csv(spark, d):
    """What a session loads from a CSV file: strings with row numbers, as cells."""
    path = new_folder(spark, "part") + ".csv"
    tables.write_csv(table(spark, d, "part").orderBy("p_partkey").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("p_brand"), "p_size").coalesce(1), path)
    session = repair.Session(spark)
    return tables.flatten(session.load_data(path))


def read_formats(spark, d):
    """The same table read by the ending of its path, whatever the format."""
    df, out = part(spark, d), []
    for kind in tables.FORMATS:
        path = new_folder(spark, "part") + "." + kind
        df.write.options(header=True).format(kind).save(path)
        out.append(tables.read(spark, path).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("s")).withColumn("format", F.lit(kind)))
    return reduce(DataFrame.union, out)


def map_schema(spark, d):
    return _session(spark, part(spark, d)).catalog.get("Map_schema")


def saved_table(spark, d):
    """A table saved in the warehouse and added to, read back and dropped with its session."""
    catalog = tables.Catalog(spark)
    df = part(spark, d).select("__ind", "p_brand")
    catalog.add("Saved", df.where("__ind % 2 = 0"), persist=True)
    catalog.add("Saved", df.where("__ind % 2 = 1"), append=True, persist=True)
    out = cut(catalog.get("Saved").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("__ind").alias("s")), "saved")
    catalog.reset()
    return out.withColumn("left", F.lit(len(catalog.tables)))


def refused_constraints(spark, d):
    """Which texts the parser refuses."""
    texts = ["t1&t2", "t1&XX(t1.p_name,'a')", "t1&EQ(t1.p_name)", "t1&EQ(t1.p_name,'a','b')", "t1&fooEQ(t1.p_name,'a')", "t1&EQ(t1.p_name,'a'x)", "t1&EQ(t1.p_name,t2.p_name)", "t1&EQ(t1.none,'a')", "t1&EQ('a',t1.p_name)", "EQ(t1.p_name,'a')", "t1&EQ(t1.p_name,'a'", "t1&EQ(t1.p_name,'a')", RULE]
    schema, rows = part(spark, d).columns, []
    for t in texts:
        try:
            parse(t, schema)
            rows.append((t, False))
        except ConstraintError:
            rows.append((t, True))
    return spark.createDataFrame(rows, "text string, refused boolean")


def train_repair(spark, d):
    df = part(spark, d)
    session = repair.Session(spark, Config(learning_iterations=3, batch_size=32, pruning_threshold1=0.02))
    session.use(df)
    session.add_denial_constraint(RULE)
    session.detect_errors([detect.ConstraintDetector(session.constraints), detect.NullDetector()])
    return session.repair().withColumnRenamed("__ind", "ind")


def _judged(spark, d):
    """Every fifth brand spoilt; suspect cells and the three likeliest values of each; the truth is the table itself."""
    df = part(spark, d)
    truth = tables.flatten(df, attrs=["p_brand"]).toDF("tid", "attr_name", "attr_val")
    spoilt = df.withColumn("p_brand", F.when(F.col("__ind") % 5 == 0, F.lit("Brand#??")).otherwise(F.col("p_brand")))
    dk = spoilt.where("__ind % 5 = 0 or __ind % 7 = 0").select(F.col("__ind").alias("ind"), F.lit("p_brand").alias("attr"))
    lookup = dom.cooccurrence(dom.pair_counts(spoilt, ["p_brand"]), dom.value_counts(spoilt), 0.0)
    found = dom.candidates(spoilt, dk, lookup).where("val <> 'Brand#??'")
    return spoilt, dk, model.top(found.withColumn("probability", F.round("p", 9)), 3), truth


def _metrics(out):
    return out.select(*[F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def precision_recall(spark, d):
    return _metrics(evaluate.compare(*_judged(spark, d)))


def compare_to_truth(spark, d):
    """The same through a session and a file of true values."""
    spoilt, dk, ranked, truth = _judged(spark, d)
    path = new_folder(spark, "truth") + ".csv"
    tables.write_csv(truth, path)
    session = _session(spark, spoilt)
    session.dk, session.inferred = dk, ranked
    return _metrics(session.compare_to_truth(path))


def wrangle_lower_trim(spark, d):
    df = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return wrangle.Transformer((text.lowercase, text.trim), ("text",)).transform(df)


def wrangle_clusters(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name")
    return wrangle.Normalizer((wrangle.ColumnNorm("p_name", threshold=2),)).normalize(df)


def _messy(spark, d):
    df = table(spark, d, "nation")
    odd = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit("'"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.substring("n_name", 1, 3), F.lit("é"), F.expr("substring(n_name, 5)"))).otherwise(F.col("n_name"))
    return df.select("n_nationkey", odd.alias("n_name"))


def wrangle_default(spark, d):
    return wrangle.default_wrangler(["n_name"]).wrangle(_messy(spark, d))


def wrangle_file(spark, d):
    """What the command line does: CSV in, CSV out."""
    source, target = (new_folder(spark, x) + ".csv" for x in ("messy", "wrangled"))
    tables.write_csv(_messy(spark, d).select("n_name"), source)
    wrangle.wrangle_file(spark, source, target)
    return tables.read(spark, target).groupBy("n_name").agg(F.count("*").alias("n"))


def wrangle_jaccard(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_type")
    return wrangle.Normalizer((wrangle.ColumnNorm("p_type", wrangle.jaccard, 0.2),)).normalize(df)


def catalog_query(spark, d):
    catalog = tables.Catalog(spark)
    catalog.add("Init", part(spark, d))
    return catalog.query("SELECT p_brand, max(p_size) AS largest, count(*) AS n FROM {Init} GROUP BY p_brand")


_PUBLIC = [read_formats, dc_union, dirty_attributes, feature_literal, feature_single, noisy_domain, noisy_features, noisy_repaired, train_step, session_repair, session_cells, loaded_csv, map_schema, saved_table, refused_constraints, compare_to_truth, wrangle_default, wrangle_file, dc_dk_cells, dc_clean_cells, dc_dependency, dc_theta, dc_equi, dc_single, dc_literal, dc_three_tuple, null_cells, regex_cells, detector_union, detector_intersect, labelled_cells, index_rows, long_columns, flat_cells, value_counts, pair_counts, cooccur_lookup, dk_domain, domain_sizes, numbered_domain, clean_domain_all, clean_domain_sampled, feature_observed, feature_constraint, feature_cooccur, feature_normalized, feature_map, dimensions, infer_softmax, infer_topk, infer_map, repaired_fixed, train_repair, precision_recall, wrangle_lower_trim, wrangle_clusters, wrangle_jaccard, catalog_query]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _PUBLIC}


# ---- the same in SQL ----

_P = "p AS (SELECT p_partkey AS ind, p_name, p_brand, p_type, p_size FROM part)"
_FLAT = "flat AS (" + " UNION ALL ".join(f"SELECT ind, '{a}' AS attr, CAST({a} AS VARCHAR) AS val FROM p" for a in ATTRS) + ")"
_DK_IDS = "bad AS (SELECT a.ind FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_brand <> b.p_brand AND a.ind <> b.ind))"
_DK = "dk AS (SELECT ind, attr FROM bad, (VALUES ('p_name'), ('p_size'), ('p_brand')) t(attr))"
_VALUES = "vals AS (SELECT attr, val, count(*) AS n FROM flat GROUP BY attr, val)"
_PAIRS = "pairs AS (SELECT x.attr, x.val, y.attr AS attr2, y.val AS val2, count(*) AS n FROM flat x JOIN flat y ON x.ind = y.ind AND x.attr <> y.attr WHERE y.attr <> 'p_type' GROUP BY ALL)"
_LOOKUP = "lookup AS (SELECT s.attr, s.val, s.attr2, s.val2, s.n / v.n AS p FROM pairs s JOIN vals v ON s.attr = v.attr AND s.val = v.val)"
_BASE = f"WITH {_P}, {_FLAT}, {_DK_IDS}, {_DK}, {_VALUES}, {_PAIRS}, {_LOOKUP}"


def _cand(cells: str) -> str:
    return f"SELECT c.ind, c.attr, l.val2 AS val, max(l.p) AS p FROM {cells} c JOIN flat f ON f.ind = c.ind AND f.attr <> c.attr JOIN lookup l ON l.attr = f.attr AND l.val = f.val AND l.attr2 = c.attr GROUP BY ALL"


_DOMAIN = (
    f"found AS ({_cand('dk')}), others AS (SELECT f.* FROM found f JOIN flat o ON o.ind = f.ind AND o.attr = f.attr WHERE f.val <> o.val AND f.p >= 0.1),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY ind, attr ORDER BY p DESC, val) AS r FROM others),"
    " dom AS (SELECT ind, attr, val, 0 AS observed FROM ranked WHERE r <= 4 UNION ALL SELECT f.ind, f.attr, f.val, 1 FROM flat f JOIN dk USING (ind, attr))"
)


def _relaxed() -> str:
    parts, i = [], 0
    for attr, op in (("p_name", "="), ("p_size", "="), ("p_brand", "<>")):
        for side in ("a", "b"):
            i += 1
            tests = [f"{'CAST(a.' + x + ' AS VARCHAR)' if not (x == attr and side == 'a') else 'd.val'} {o} {'CAST(b.' + x + ' AS VARCHAR)' if not (x == attr and side == 'b') else 'd.val'}" for x, o in (("p_name", "="), ("p_size", "="), ("p_brand", "<>"))]
            parts.append(f"SELECT d.ind, d.attr, d.val, 'DC{i}' AS feature, CAST(count(*) AS DOUBLE) AS value FROM dom d JOIN p {side} ON d.ind = {side}.ind AND d.attr = '{attr}' JOIN p {'b' if side == 'a' else 'a'} ON {' AND '.join(tests)} AND a.ind < b.ind GROUP BY ALL")
    return " UNION ALL ".join(parts)


_F_INIT = "SELECT ind, attr, val, 'Init' AS feature, CAST(1.0 AS DOUBLE) AS value FROM dom WHERE observed = 1"
_F_CO = "SELECT d.ind, d.attr, d.val, 'Cooccur:' || f.attr AS feature, s.n / v.n AS value FROM dom d JOIN flat f ON f.ind = d.ind AND f.attr <> d.attr AND f.attr <> 'p_type' JOIN pairs s ON s.attr = f.attr AND s.val = f.val AND s.attr2 = d.attr AND s.val2 = d.val JOIN vals v ON v.attr = f.attr AND v.val = f.val"
_FEATURES = f"feats AS ({_F_INIT} UNION ALL {_relaxed()} UNION ALL {_F_CO}), norm AS (SELECT ind, attr, val, feature, value / sqrt(sum(value * value) OVER (PARTITION BY ind, attr, val)) AS value FROM feats)"
_INFER = (
    "w(feature, weight) AS (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in WEIGHTS.items()) + "),"
    " sc AS (SELECT ind, attr, val, sum(value * weight) AS s FROM norm JOIN w USING (feature) GROUP BY ALL),"
    " ex AS (SELECT d.*, exp(coalesce(s, 0) - max(coalesce(s, 0)) OVER (PARTITION BY d.ind, d.attr)) AS e FROM dom d LEFT JOIN sc USING (ind, attr, val)),"
    " inf AS (SELECT ind, attr, val, observed, round(e / sum(e) OVER (PARTITION BY ind, attr), 7) AS probability FROM ex),"
    " top AS (SELECT *, row_number() OVER (PARTITION BY ind, attr ORDER BY probability DESC, val) AS rank FROM inf WHERE probability > 0)"
)
_DOM = f"{_BASE}, {_DOMAIN}"
_ALL = f"{_DOM}, {_FEATURES}, {_INFER}"
_TRAIN = "tr AS (SELECT ind, attr FROM flat WHERE attr <> 'p_type' EXCEPT SELECT ind, attr FROM dk)"
_CLEAN = f"cf AS ({_cand('tr')}), cd AS (SELECT f.ind, f.attr, f.val, 0 AS observed FROM cf f JOIN flat o ON o.ind = f.ind AND o.attr = f.attr WHERE f.val <> o.val UNION ALL SELECT ind, attr, val, 1 FROM flat JOIN tr USING (ind, attr)), clean AS (SELECT * FROM cd QUALIFY count(*) OVER (PARTITION BY ind, attr) > 1)"
_REGEX_BAD = "rx AS (SELECT ind, 'p_type' AS attr FROM p WHERE NOT regexp_matches(p_type, '^(ECONOMY|STANDARD|SMALL)'))"
_FOLD = r"lower(regexp_replace(nfc_normalize(strip_accents(coalesce(text, ''))), '[^\x00-\x7F]', '', 'g'))"
_TRIM = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FOLD}, '^[\x09-\x0D\x1C-\x20]+|[\x09-\x0D\x1C-\x20]+$', '', 'g'), '\n+', '', 'g'), '[\x09-\x0D\x1C-\x20]+', ' ', 'g'), '[\"'']', '', 'g')"


#: The table that noisy() makes, under the name of the other.
_NOISY = "p AS (SELECT p_partkey AS ind, p_brand AS p_name, CASE WHEN p_partkey % 20 = 0 THEN 'Brand#9' ELSE substr(p_brand, 1, 7) END AS p_brand, p_type, CAST(p_size % 2 AS INTEGER) AS p_size FROM part)"
_SWAPPED = "dom AS (SELECT ind, 'p_name' AS attr, p_name AS val FROM p WHERE ind % 3 = 0 UNION ALL SELECT ind, 'p_brand', p_brand FROM p WHERE ind % 3 = 0 UNION ALL SELECT ind, 'p_type', p_type FROM p WHERE ind % 3 = 0 UNION ALL SELECT ind, 'p_brand', p_type FROM p WHERE ind % 3 = 0 UNION ALL SELECT ind, 'p_type', p_brand FROM p WHERE ind % 3 = 0 UNION ALL SELECT ind, 'p_brand', 'Brand#11 ' FROM p WHERE ind % 3 = 0)"


def _swap_count(number: int, attr: str, own: str, other: str, condition: str) -> str:
    """Feature DCn of the candidates for attr of tuple `own`; d.val stands for the candidate."""
    return f"SELECT d.ind, d.attr, d.val, 'DC{number}' AS feature, CAST(count(*) AS DOUBLE) AS value FROM dom d JOIN p {own} ON d.ind = {own}.ind AND d.attr = '{attr}' JOIN p {other} ON {condition} GROUP BY ALL"


_LITERAL = " UNION ALL ".join([
    _swap_count(1, "p_brand", "a", "b", "d.val = 'Brand#11' AND b.p_brand = 'Brand#22' AND a.p_name = b.p_name AND a.ind < b.ind"),
    _swap_count(2, "p_brand", "b", "a", "a.p_brand = 'Brand#11' AND d.val = 'Brand#22' AND a.p_name = b.p_name AND a.ind < b.ind"),
    _swap_count(3, "p_name", "a", "b", "a.p_brand = 'Brand#11' AND b.p_brand = 'Brand#22' AND d.val = b.p_name AND a.ind < b.ind"),
    _swap_count(4, "p_name", "b", "a", "a.p_brand = 'Brand#11' AND b.p_brand = 'Brand#22' AND a.p_name = d.val AND a.ind < b.ind"),
    _swap_count(5, "p_name", "a", "b", "d.val = b.p_name AND a.p_type = b.p_brand AND a.ind < b.ind"),
    _swap_count(6, "p_name", "b", "a", "a.p_name = d.val AND a.p_type = b.p_brand AND a.ind < b.ind"),
    _swap_count(7, "p_type", "a", "b", "a.p_name = b.p_name AND d.val = b.p_brand AND a.ind <> b.ind"),
    _swap_count(8, "p_brand", "b", "a", "a.p_name = b.p_name AND a.p_type = d.val AND a.ind <> b.ind"),
])
_SINGLE = " UNION ALL ".join(f"SELECT d.ind, d.attr, d.val, 'DC{n}' AS feature, CAST(count(*) AS DOUBLE) AS value FROM dom d JOIN p a ON d.ind = a.ind AND d.attr = '{attr}' WHERE {test} GROUP BY ALL" for n, attr, test in ((1, "p_brand", "d.val = 'Brand#11' AND a.p_type > 'M'"), (2, "p_type", "a.p_brand = 'Brand#11' AND d.val > 'M'")))
_MESSY = "m AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) WHEN n_nationkey % 3 = 1 THEN lower(substr(n_name, 1, 3)) || 'e' || lower(substr(n_name, 5)) ELSE lower(n_name) END AS v FROM nation)"
_CLUSTERED = "c AS (SELECT v, count(*) AS n FROM m GROUP BY 1), e AS (SELECT a.v AS a, b.v AS b FROM c a JOIN c b ON {0}), r(v, u) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a), x AS (SELECT r.v, first(c.v ORDER BY c.n DESC, c.v) AS best FROM r JOIN c ON c.v = r.u GROUP BY r.v)"
_NEAR = "levenshtein(a.v, b.v) <= 3"
_CHARS = "list_distinct(string_split({0}.v, ''))"
_LIKE = f"len(list_intersect({_CHARS.format('a')}, {_CHARS.format('b')})) * 1.0 / len(list_distinct(list_concat({_CHARS.format('a')}, {_CHARS.format('b')}))) >= 0.8"
_STEP = "ys AS (SELECT i.*, i.e / sum(i.e) OVER (PARTITION BY i.ind, i.attr) - i.observed AS off FROM ex i), ce AS (SELECT count(*) AS n FROM (SELECT DISTINCT ind, attr FROM dom)), gr AS (SELECT feature, sum(value * off) / any_value(ce.n) AS g FROM norm JOIN ys USING (ind, attr, val), ce GROUP BY feature)"


def _explode(ids: str, attrs: list[str]) -> str:
    return f"SELECT ind, attr FROM ({ids}), (VALUES {', '.join(f'({chr(39)}{a}{chr(39)})' for a in attrs)}) t(attr)"


def oracle_sql() -> dict[str, str]:
    theta = "SELECT s_suppkey AS ind FROM supplier x WHERE EXISTS (SELECT 1 FROM supplier y WHERE {0} AND x.s_suppkey <> y.s_suppkey)"
    equi = "SELECT o_orderkey AS ind FROM orders x WHERE EXISTS (SELECT 1 FROM orders y WHERE x.o_custkey = y.o_custkey AND {0} AND x.o_orderkey <> y.o_orderkey)"
    lit = "SELECT p_partkey AS ind FROM part x WHERE p_brand = '{0}' AND EXISTS (SELECT 1 FROM part y WHERE y.p_brand = '{1}' AND x.p_name = y.p_name AND x.p_partkey <> y.p_partkey)"
    three = "n3 AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y, c.n_nationkey AS z FROM nation a, nation b, nation c WHERE a.n_regionkey = b.n_regionkey AND b.n_regionkey = c.n_regionkey AND a.n_name < b.n_name AND b.n_name < c.n_name AND a.n_nationkey <> b.n_nationkey AND b.n_nationkey <> c.n_nationkey AND a.n_nationkey <> c.n_nationkey)"
    line = "SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS ind FROM lineitem x WHERE EXISTS (SELECT 1 FROM lineitem y WHERE x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber AND x.l_returnflag <> y.l_returnflag)"
    spoilt = "sp AS (SELECT p_partkey AS ind, p_name, CASE WHEN p_partkey % 5 = 0 THEN 'Brand#??' ELSE p_brand END AS p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, p_brand AS truth FROM part)"
    near = " UNION ALL ".join(f"SELECT '{a}' AS attr, {a} AS val, p_brand AS val2, count(*) AS n FROM sp GROUP BY ALL" for a in ("p_name", "p_type", "p_size"))
    alone = " UNION ALL ".join(f"SELECT '{a}' AS attr, {a} AS val, count(*) AS n FROM sp GROUP BY ALL" for a in ("p_name", "p_type", "p_size"))
    rows = " UNION ALL ".join(f"SELECT ind, '{a}' AS attr, {a} AS val FROM sp WHERE ind % 5 = 0 OR ind % 7 = 0" for a in ("p_name", "p_type", "p_size"))
    judged = f"WITH {spoilt}, pr AS ({near}), al AS ({alone}), rw AS ({rows}), fd AS (SELECT rw.ind, pr.val2 AS val, round(max(pr.n / al.n), 9) AS p FROM rw JOIN pr ON rw.attr = pr.attr AND rw.val = pr.val JOIN al ON al.attr = rw.attr AND al.val = rw.val WHERE pr.val2 <> 'Brand#??' GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY ind ORDER BY p DESC, val) AS r FROM fd QUALIFY r <= 3), jd AS (SELECT rk.ind, max(CAST(val = truth AS INT)) AS hit, max(CASE WHEN r = 1 THEN CAST(val = truth AS INT) END) AS map_hit, any_value(sp.p_brand <> sp.truth) AS err FROM rk JOIN sp ON sp.ind = rk.ind GROUP BY rk.ind), e AS (SELECT count(*) AS n FROM sp WHERE p_brand <> truth) SELECT count(*) AS inferred, CAST(sum(hit) AS BIGINT) AS correct, (SELECT n FROM e) AS detected_errors, (SELECT n FROM e) AS total_errors, round(sum(hit) / count(*), 7) AS precision, round(1 - sum(CASE WHEN err AND hit = 0 THEN 1 ELSE 0 END) / (SELECT n FROM e), 7) AS recall, round(sum(map_hit) / count(*), 7) AS map_precision, round(1 - sum(CASE WHEN err AND map_hit = 0 THEN 1 ELSE 0 END) / (SELECT n FROM e), 7) AS map_recall FROM jd"
    sampled = f"{_BASE}, {_TRAIN}, cf AS ({_cand('tr')}), ot AS (SELECT f.*, row_number() OVER (PARTITION BY f.ind, f.attr ORDER BY f.p DESC, f.val) AS r FROM cf f JOIN flat o ON o.ind = f.ind AND o.attr = f.attr WHERE f.val <> o.val), dr AS (SELECT *, row_number() OVER (PARTITION BY ind, attr ORDER BY CASE WHEN r > 1 THEN md5('42|' || ind || '|' || attr || '|' || val) END NULLS FIRST, r) AS s FROM ot), cd AS (SELECT ind, attr, val, 0 AS observed FROM dr WHERE s <= 4 UNION ALL SELECT ind, attr, val, 1 FROM flat JOIN tr USING (ind, attr)) SELECT * FROM cd QUALIFY count(*) OVER (PARTITION BY ind, attr) > 1"
    repaired_all = f"{_ALL} SELECT p.ind, " + ", ".join(f"coalesce((SELECT {'CAST(val AS INTEGER)' if a == 'p_size' else 'val'} FROM top t WHERE t.ind = p.ind AND t.attr = '{a}' AND rank = 1), p.{a}) AS {a}" for a in ATTRS) + " FROM p"
    normal = f"{_DOM}, {_FEATURES} SELECT ind, attr, val, feature, round(value, 7) AS value FROM norm"
    refused = ["t1&t2", "t1&XX(t1.p_name,'a')", "t1&EQ(t1.p_name)", "t1&EQ(t1.p_name,'a','b')", "t1&fooEQ(t1.p_name,'a')", "t1&EQ(t1.p_name,'a'x)", "t1&EQ(t1.p_name,t2.p_name)", "t1&EQ(t1.none,'a')", "t1&EQ('a',t1.p_name)", "EQ(t1.p_name,'a')", "t1&EQ(t1.p_name,'a'"]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return {
        "read_formats": "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, format FROM part, (VALUES ('csv'), ('parquet'), ('orc'), ('json')) t(format) GROUP BY p_brand, format",
        "dc_union": f"WITH {_P}, {_DK_IDS}, {_DK} SELECT ind, attr FROM dk UNION SELECT ind, attr FROM ({_explode(lit.format('Brand#11', 'Brand#22') + ' UNION ' + lit.format('Brand#22', 'Brand#11'), ['p_brand', 'p_name'])}) UNION SELECT ind, 'p_type' FROM p WHERE p_type > 'T'",
        "dirty_attributes": f"WITH {_P}, {_DK_IDS}, {_DK} SELECT DISTINCT attr FROM dk",
        "feature_literal": f"WITH {_P}, {_SWAPPED} SELECT ind, attr, val, feature, value FROM ({_LITERAL})",
        "feature_single": f"WITH {_P}, {_SWAPPED} SELECT ind, attr, val, feature, value FROM ({_SINGLE})",
        "noisy_domain": f"{_DOM} SELECT ind, attr, val, observed FROM dom".replace(_P, _NOISY),
        "noisy_features": normal.replace(_P, _NOISY),
        "noisy_repaired": repaired_all.replace(_P, _NOISY),
        "session_repair": repaired_all.replace(_P, _NOISY),
        "train_step": f"{_ALL}, {_STEP} SELECT w.feature, round(w.weight - 0.5 * (coalesce(gr.g, 0) + 0.1 * w.weight), 7) AS weight FROM w LEFT JOIN gr USING (feature)".replace(_P, _NOISY),
        "session_cells": "SELECT p_partkey AS ind, 'p_brand' AS attr, given FROM part, (VALUES ('dirty'), ('clean')) t(given) WHERE p_size > 40",
        "loaded_csv": "WITH o AS (SELECT row_number() OVER (ORDER BY p_partkey) AS ind, * FROM part) SELECT ind, 'p_partkey' AS attr, CAST(p_partkey AS VARCHAR) AS val FROM o UNION ALL SELECT ind, 'p_name', p_name FROM o UNION ALL SELECT ind, 'p_brand', CASE WHEN p_partkey % 7 <> 0 THEN p_brand END FROM o UNION ALL SELECT ind, 'p_size', CAST(p_size AS VARCHAR) FROM o",
        "map_schema": "SELECT * FROM (VALUES (1, 'p_name'), (2, 'p_brand'), (3, 'p_type'), (4, 'p_size')) t(attr_id, attribute)",
        "saved_table": "SELECT p_brand, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS s, CAST(0 AS INTEGER) AS left FROM part GROUP BY p_brand",
        "refused_constraints": "SELECT * FROM (VALUES " + ", ".join(f"({quoted(x)}, true)" for x in refused) + f", ('t1&EQ(t1.p_name,''a'')', false), ({quoted(RULE)}, false)) t(text, refused)",
        "compare_to_truth": judged,
        "wrangle_default": f"WITH RECURSIVE {_MESSY}, {_CLUSTERED.format(_NEAR)} SELECT n_nationkey, x.best AS n_name FROM m JOIN x USING (v)",
        "wrangle_file": f"WITH RECURSIVE {_MESSY}, {_CLUSTERED.format(_NEAR)} SELECT x.best AS n_name, count(*) AS n FROM m JOIN x USING (v) GROUP BY 1",
        "wrangle_jaccard": f"WITH RECURSIVE m AS (SELECT p_partkey, p_type AS v FROM part), {_CLUSTERED.format(_LIKE)} SELECT p_partkey, x.best AS p_type FROM m JOIN x USING (v)",
        "clean_domain_sampled": sampled,
        "dc_dk_cells": f"WITH {_P}, {_DK_IDS}, {_DK} SELECT ind, attr FROM dk",
        "dc_clean_cells": f"WITH {_P}, {_FLAT}, {_DK_IDS}, {_DK} SELECT ind, attr FROM flat EXCEPT SELECT ind, attr FROM dk",
        "dc_dependency": f"SELECT DISTINCT ind, attr FROM ({_explode(line, ['l_orderkey', 'l_linenumber', 'l_returnflag'])})",
        "dc_theta": f"SELECT DISTINCT ind, attr FROM ({_explode(theta.format('x.s_nationkey < y.s_nationkey AND x.s_acctbal >= y.s_acctbal') + ' UNION ' + theta.format('y.s_nationkey < x.s_nationkey AND y.s_acctbal >= x.s_acctbal'), ['s_nationkey', 's_acctbal'])})",
        "dc_equi": f"SELECT DISTINCT ind, attr FROM ({_explode(equi.format('x.o_totalprice > y.o_totalprice AND x.o_orderstatus <= y.o_orderstatus') + ' UNION ' + equi.format('y.o_totalprice > x.o_totalprice AND y.o_orderstatus <= x.o_orderstatus'), ['o_custkey', 'o_totalprice', 'o_orderstatus'])})",
        "dc_single": _explode("SELECT o_orderkey AS ind FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'", ["o_orderstatus", "o_orderpriority"]),
        "dc_literal": f"SELECT DISTINCT ind, attr FROM ({_explode(lit.format('Brand#11', 'Brand#22') + ' UNION ' + lit.format('Brand#22', 'Brand#11'), ['p_brand', 'p_name'])})",
        "dc_three_tuple": f"WITH {three} SELECT DISTINCT ind, attr FROM ({_explode('SELECT x AS ind FROM n3 UNION SELECT y FROM n3 UNION SELECT z FROM n3', ['n_regionkey', 'n_name'])})",
        "null_cells": "SELECT c_custkey AS ind, 'c_name' AS attr FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_custkey % 7 = 0",
        "regex_cells": "SELECT conv_id * 1000 + turn AS ind, 'text' AS attr FROM conversations WHERE NOT regexp_matches(text, '[0-9]{2}')",
        "detector_union": f"WITH {_P}, {_DK_IDS}, {_DK}, {_REGEX_BAD} SELECT ind, attr FROM dk UNION SELECT ind, attr FROM rx",
        "detector_intersect": f"WITH {_P}, {_FLAT}, {_DK_IDS}, {_DK}, {_REGEX_BAD} SELECT ind, attr FROM flat EXCEPT SELECT ind, attr FROM dk EXCEPT SELECT ind, attr FROM rx",
        "labelled_cells": f"WITH {_P}, {_FLAT} SELECT ind, attr FROM flat EXCEPT SELECT ind, 'p_brand' FROM p WHERE p_size > 40",
        "index_rows": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS __ind FROM orders",
        "long_columns": "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL",
        "flat_cells": f"WITH {_P}, {_FLAT} SELECT ind, attr, val FROM flat",
        "value_counts": f"WITH {_P}, {_FLAT}, {_VALUES} SELECT attr, val, n FROM vals",
        "pair_counts": f"WITH {_P}, {_FLAT}, {_PAIRS} SELECT attr, val, attr2, val2, n FROM pairs",
        "cooccur_lookup": f"{_BASE} SELECT attr, val, attr2, val2, round(p, 9) AS p FROM lookup WHERE p > 0.05",
        "dk_domain": f"{_DOM} SELECT ind, attr, val, observed FROM dom",
        "domain_sizes": f"{_DOM} SELECT ind, attr, count(*) AS k_ij FROM dom GROUP BY ALL",
        "numbered_domain": f"{_DOM} SELECT dense_rank() OVER (ORDER BY ind, CASE attr WHEN 'p_name' THEN 0 WHEN 'p_brand' THEN 1 WHEN 'p_type' THEN 2 ELSE 3 END) AS vid, ind, attr, val, observed, CAST(row_number() OVER (PARTITION BY ind, attr ORDER BY val) AS INTEGER) AS domain_id FROM dom",
        "clean_domain_all": f"{_BASE}, {_TRAIN}, {_CLEAN} SELECT ind, attr, val, observed FROM clean",
        "feature_observed": f"{_DOM} {_F_INIT}",
        "feature_constraint": f"{_DOM} {_relaxed()}",
        "feature_cooccur": f"{_DOM} SELECT ind, attr, val, feature, round(value, 9) AS value FROM ({_F_CO})",
        "feature_normalized": normal,
        "feature_map": "SELECT * FROM (VALUES (1, 'Init', 'Init', 'Init'), (2, 'DC1', 'p_name', 'DC'), (3, 'DC2', 'p_name', 'DC'), (4, 'DC3', 'p_size', 'DC'), (5, 'DC4', 'p_size', 'DC'), (6, 'DC5', 'p_brand', 'DC'), (7, 'DC6', 'p_brand', 'DC'), (8, 'Cooccur:p_name', 'p_name', 'Cooccur'), (9, 'Cooccur:p_brand', 'p_brand', 'Cooccur'), (10, 'Cooccur:p_size', 'p_size', 'Cooccur')) t(feature_ind, feature, attribute, type)",
        "dimensions": f"{_DOM}, {_TRAIN}, {_CLEAN} SELECT 'N' AS dimension, (SELECT count(*) FROM (SELECT DISTINCT ind, attr FROM clean)) AS length UNION ALL SELECT 'M', 10 UNION ALL SELECT 'L', (SELECT max(k) FROM (SELECT count(*) AS k FROM (SELECT ind, attr FROM clean UNION ALL SELECT ind, attr FROM dom) GROUP BY ind, attr))",
        "infer_softmax": f"{_ALL} SELECT * FROM inf",
        "infer_topk": f"{_ALL} SELECT ind, attr, val, observed, probability, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 2",
        "infer_map": f"{_ALL} SELECT ind, attr, val FROM top WHERE rank = 1",
        "repaired_fixed": repaired_all,
        "precision_recall": judged,
        "wrangle_lower_trim": f"SELECT conv_id, turn, {_TRIM} AS text FROM conversations",
        "wrangle_clusters": "WITH RECURSIVE c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1), e AS (SELECT a.v AS a, b.v AS b FROM c a JOIN c b ON levenshtein(a.v, b.v) <= 2), r(v, u) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a), x AS (SELECT r.v, first(c.v ORDER BY c.n DESC, c.v) AS best FROM r JOIN c ON c.v = r.u GROUP BY r.v) SELECT p_partkey, x.best AS p_name FROM part JOIN x ON x.v = part.p_name",
        "catalog_query": "SELECT p_brand, max(p_size) AS largest, count(*) AS n FROM part GROUP BY p_brand",
    }

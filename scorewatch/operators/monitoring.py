"""Reference snapshots, alerts against them and root-cause attribution."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.expr import bucket_of, finite, kept, long_bins, ratio, small_table, union_all
from scorewatch.functions.ranks import quantile_lists, quantiles
from scorewatch.functions.tokens import short_hash
from scorewatch.operators.contract import require_columns
from scorewatch.operators.metrics import column_rates
from scorewatch.roles import ContractError, Roles, numeric_columns
from scorewatch.sources.scratch import staged

# Quartiles of the reference, alert thresholds and alert types.
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
MISSING_WARNING, MISSING_CRITICAL = 0.10, 0.25
PSI_WARNING, PSI_CRITICAL = 0.20, 0.30
LABEL_WARNING, LABEL_CRITICAL = 0.03, 0.08
DECAY_WARNING, DECAY_CRITICAL = 0.20, 0.40
SHARE_WARNING = 0.10
PROBABILITY_FLOOR = 1e-6
ALERT_TYPES = ("schema", "missingness", "distribution", "population", "label", "rule_decay")
DIMENSIONS = ("segment", "family", "feature", "target", "rule", "schema")

ALERT_FIELDS = (
    "alert_id",
    "alert_type",
    "severity",
    "scope",
    "scope_value",
    "metric",
    "reference_value",
    "current_value",
    "reference_text",
    "current_text",
    "delta",
    "evidence",
)
FEATURE_SCHEMA = (
    "feature string, family string, dtype string, missing_rate double, zero_rate double, "
    "edges array<double>, counts array<long>"
)
HEAD_SCHEMA = (
    "dataset_id string, row_count long, positive_rate double, min_group_size int, "
    "entity string, snapshot string, segment string, target string"
)
RULE_SCHEMA = "rule_id string, coverage double, bad_rate double, lift double"


@dataclass(frozen=True)
class FeatureReference:
    feature: str
    family: str
    dtype: str
    missing_rate: float
    zero_rate: float
    edges: tuple[float, ...]
    counts: tuple[int, ...]


@dataclass(frozen=True)
class Snapshot:
    """Aggregate reference: one entry per feature; segments and rules stay tables."""

    dataset_id: str
    row_count: int
    positive_rate: float
    roles: Roles
    min_group_size: int
    features: tuple[FeatureReference, ...]
    segments: DataFrame = field(compare=False)
    rules: DataFrame | None = field(default=None, compare=False)


def dtype_family(dtype: T.DataType | str) -> str:
    """numeric, boolean, string or temporal (other types by name)."""
    name = dtype if isinstance(dtype, str) else dtype.simpleString()
    if re.match(r"(tinyint|smallint|int|bigint|float|double|decimal)", name):
        return "numeric"
    if name.startswith(("boolean", "bool")):
        return "boolean"
    if name.startswith(("string", "varchar", "char")):
        return "string"
    if name.startswith(("date", "timestamp", "time", "interval")):
        return "temporal"
    return name


def _encoded(letters: str, plain: str) -> str:
    """Pattern of a sign as it is or percent-encoded, at any depth of encoding."""
    codes = "|".join(f"{ord(c):02x}" for c in letters)
    return f"(?:{plain}|%(?:25)*(?:{codes}))"


_ANY_LETTER = r"(?:[a-z]|%(?:25)*[46][1-9a-f]|%(?:25)*[57][0-9a])"
_COLON = _encoded(":", ":")
#: A slash or backslash anywhere, a drive letter or the file scheme ahead.
PATH_LIKE = (
    f"(?i){_encoded('/', '/')}|{_encoded(chr(92), chr(92) * 2)}|^{_ANY_LETTER}{_COLON}|^"
    + "".join(_encoded(c + c.upper(), c) for c in "file")
    + _COLON
)


def path_like(text: Column) -> Column:
    """Whether an identifier looks like a path, also when percent-encoded."""
    return F.rlike(text, F.lit(PATH_LIKE))


def no_path(text: Column, what: str) -> Column:
    """The identifier itself; a path-like one fails the job."""
    message = F.lit(f"path-like {what} is not allowed in a reference snapshot")
    return F.when(path_like(text), F.raise_error(message).cast("string")).otherwise(text)


# --- building the reference ---------------------------------------------------------


def reference_edges(df: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Deduplicated quartile edges of the finite values; a constant gives two equal edges."""
    stats = quantile_lists(quantiles(df, features, QUARTILES))
    edges = {}
    for f in features:
        distinct = list(dict.fromkeys(stats[f]["q"])) if f in stats else []
        edges[f] = distinct * 2 if len(distinct) == 1 else distinct
    return edges


def bin_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], *by: str) -> DataFrame:
    """Finite rows per feature and bin; values outside the edges go to the end bins."""
    usable = {f: e for f, e in edges.items() if len(e) > 1 and f in df.columns}
    if not usable:
        schema = ", ".join([*(f"{b} string" for b in by), "feature string, bin int, n long"])
        return df.sparkSession.createDataFrame([], schema)
    # Inner edges only: two equal edges are one bin.
    inner = {f: list(e[1:-1]) for f, e in usable.items()}
    return long_bins(df, inner, *by).groupBy(*by, "feature", "bin").agg(F.count("*").alias("n"))


def reference_features(
    df: DataFrame, features: Sequence[str], catalog: DataFrame | None = None
) -> list[FeatureReference]:
    """Missing and zero rate, quartile edges and histogram of every feature."""
    require_columns(df, features, "feature")
    unsupported = sorted(set(features) - set(numeric_columns(df.schema, features)))
    if unsupported:
        raise ContractError(f"numeric features are required: {', '.join(unsupported)}")
    families = {} if catalog is None else {r["feature"]: r["source"] for r in catalog.collect()}
    counts: dict[str, dict[int, int]] = {}
    with kept(df, *features) as rows:
        rates = {r["feature"]: r for r in column_rates(rows, features).collect()}
        edges = reference_edges(rows, features)
        for r in bin_counts(rows, edges).collect():
            counts.setdefault(r["feature"], {})[r["bin"]] = r["n"]
    return [
        FeatureReference(
            f,
            families.get(f, "unknown"),
            df.schema[f].dataType.simpleString(),
            float(rates[f]["missing_rate"]),
            float(rates[f]["zero_rate"]),
            tuple(edges[f]),
            tuple(counts.get(f, {}).get(b, 0) for b in range(max(0, len(edges[f]) - 1))),
        )
        for f in features
    ]


def reference_frame(spark: SparkSession, features: Sequence[FeatureReference]) -> DataFrame:
    rows = [
        (f.feature, f.family, f.dtype, f.missing_rate, f.zero_rate, list(f.edges), list(f.counts))
        for f in features
    ]
    return spark.createDataFrame(rows, FEATURE_SCHEMA)


def features_from_frame(df: DataFrame) -> list[FeatureReference]:
    return [
        FeatureReference(
            r["feature"], r["family"], r["dtype"], r["missing_rate"], r["zero_rate"],
            tuple(r["edges"]), tuple(r["counts"]),
        )
        for r in df.orderBy("feature").collect()
    ]


def reference_segments(df: DataFrame, segment: str, min_group_size: int) -> DataFrame:
    """Segment counts of groups that are large enough; a path-like label of any size is an error."""
    label = F.coalesce(F.col(segment).cast("string"), F.lit("None"))
    counted = df.groupBy(label.alias("segment")).agg(F.count("*").alias("n"))
    guarded = counted.withColumn("segment", no_path(F.col("segment"), "segment label"))
    # The guard is part of the condition: a filter on the count alone would run before it.
    large = F.when(F.col("segment").isNotNull(), F.col("n") >= min_group_size)
    return guarded.filter(large)


def reference_rules(evidence: DataFrame) -> DataFrame:
    """Coverage, bad rate and lift of the test slice; rule ids must be unique."""
    copies = F.count("*").over(W.partitionBy("rule_id"))
    return evidence.select(
        F.when(copies > 1, F.raise_error(F.lit("duplicate rule identifier")).cast("string"))
        .otherwise(no_path(F.col("rule_id"), "rule identifier"))
        .alias("rule_id"),
        "coverage",
        F.col("hit_bad_rate").alias("bad_rate"),
        "lift",
    )


def build_snapshot(
    df: DataFrame,
    roles: Roles,
    features: Sequence[str],
    *,
    dataset_id: str,
    min_group_size: int = 100,
    catalog: DataFrame | None = None,
    evidence: DataFrame | None = None,
) -> Snapshot:
    """Aggregate-only reference of one table."""
    totals = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(roles.target) == 1).alias("pos"),
        path_like(F.lit(dataset_id)).alias("path"),
    ).first()
    if totals["path"]:
        raise ContractError("path-like dataset identifier is not allowed in a reference snapshot")
    return Snapshot(
        dataset_id,
        totals["n"],
        totals["pos"] / totals["n"] if totals["n"] else 0.0,
        roles,
        min_group_size,
        tuple(reference_features(df, features, catalog)),
        reference_segments(df, roles.segment, min_group_size),
        None if evidence is None else reference_rules(evidence),
    )


def save_snapshot(snapshot: Snapshot, path: str) -> None:
    """Write the snapshot as Parquet tables below ``path``: head, features, segments and rules."""
    spark = snapshot.segments.sparkSession
    r = snapshot.roles
    head = spark.createDataFrame(
        [
            (
                snapshot.dataset_id, snapshot.row_count, snapshot.positive_rate,
                snapshot.min_group_size, r.entity, r.snapshot, r.segment, r.target,
            )
        ],
        HEAD_SCHEMA,
    )
    reference_frame(spark, snapshot.features).write.parquet(f"{path}/features")
    snapshot.segments.write.parquet(f"{path}/segments")
    rules = snapshot.rules
    head = head.withColumn("with_rules", F.lit(rules is not None))
    head.write.parquet(f"{path}/head")
    (spark.createDataFrame([], RULE_SCHEMA) if rules is None else rules).write.parquet(f"{path}/rules")


def load_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The snapshot that ``save_snapshot`` wrote below ``path``."""
    head = spark.read.parquet(f"{path}/head").first()
    return Snapshot(
        head["dataset_id"],
        head["row_count"],
        head["positive_rate"],
        Roles(head["entity"], head["snapshot"], head["segment"], head["target"]),
        head["min_group_size"],
        tuple(features_from_frame(spark.read.parquet(f"{path}/features"))),
        spark.read.parquet(f"{path}/segments"),
        spark.read.parquet(f"{path}/rules") if head["with_rules"] else None,
    )


def snapshot_id(snapshot: Snapshot) -> DataFrame:
    """SHA-256 over the snapshot tables, in canonical order; one row."""
    spark = snapshot.segments.sparkSession
    features = reference_frame(spark, snapshot.features)

    def digest(df: DataFrame, key: str) -> DataFrame:
        row = F.to_json(F.struct(*sorted(df.columns)))
        return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(key, row.alias("r"))))).alias("t"))

    parts = [digest(features, "feature"), digest(snapshot.segments, "segment")]
    if snapshot.rules is not None:
        parts.append(digest(snapshot.rules, "rule_id"))
    head = f"{snapshot.dataset_id}|{snapshot.row_count}|{snapshot.positive_rate!r}|{snapshot.min_group_size}"
    tagged = [p.select(F.lit(i).alias("i"), "t") for i, p in enumerate(parts)]
    return union_all(tagged).agg(
        F.sha2(
            F.concat(
                F.lit(head),
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), "|"
                ),
            ),
            256,
        ).alias("snapshot_id")
    )


# --- alerts -----------------------------------------------------------------------------


def alert_rows(
    df: DataFrame,
    alert_type: str,
    scope: str,
    metric: Column | str,
    scope_value: Column,
    severity: Column,
    *,
    reference: Column | None = None,
    current: Column | None = None,
    reference_text: Column | None = None,
    current_text: Column | None = None,
    delta: Column | None = None,
    evidence: Mapping[str, Column] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Shape rows into alerts, each with the id of its type, scope, value and metric."""
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    metric = F.lit(metric) if isinstance(metric, str) else metric
    entries = [v for k, c in sorted((evidence or {}).items()) for v in (F.lit(k), c.cast("double"))]
    empty = F.create_map().cast("map<string,double>")
    key = F.concat_ws("|", F.lit(alert_type), F.lit(scope), scope_value, metric)
    return df.select(
        *keep,
        short_hash(key, 12).alias("alert_id"),
        F.lit(alert_type).alias("alert_type"),
        severity.alias("severity"),
        F.lit(scope).alias("scope"),
        scope_value.alias("scope_value"),
        metric.alias("metric"),
        (number if reference is None else reference.cast("double")).alias("reference_value"),
        (number if current is None else current.cast("double")).alias("current_value"),
        (text if reference_text is None else reference_text).alias("reference_text"),
        (text if current_text is None else current_text).alias("current_text"),
        (number if delta is None else delta.cast("double")).alias("delta"),
        (F.create_map(*entries) if entries else empty).alias("evidence"),
    )


def two_level(value: Column, warning: float, critical: float) -> Column:
    """critical, warning or null; compare an absolute value for two-sided alerts."""
    return F.when(value >= critical, "critical").when(value >= warning, "warning")


def schema_alerts(snapshot: Snapshot, current: DataFrame) -> DataFrame:
    """Missing role, missing feature and changed type family: all critical."""
    roles = snapshot.roles
    expected = [("dataset", c, "role_column", role, None) for role, c in (
        ("target", roles.target), ("segment", roles.segment)
    )] + [("feature", f.feature, "column", f.dtype, dtype_family(f.dtype)) for f in snapshot.features]
    spark = current.sparkSession
    reference = spark.createDataFrame(
        expected, "scope string, name string, metric string, text string, family string"
    )
    actual = spark.createDataFrame(
        [(f.name, dtype_family(f.dataType)) for f in current.schema],
        "name string, current_family string",
    )
    joined = reference.join(actual, "name", "left")
    gone = F.col("current_family").isNull()
    changed = ~gone & F.col("family").isNotNull() & (F.col("family") != F.col("current_family"))
    critical = F.lit("critical")
    frames = [
        alert_rows(
            joined.filter(gone & (F.col("scope") == scope)), "schema", scope, F.col("metric"),
            F.col("name"), critical, reference_text=F.col("text"),
        )
        for scope in ("dataset", "feature")
    ]
    frames.append(
        alert_rows(
            joined.filter(changed), "schema", "feature", "dtype_family", F.col("name"), critical,
            reference_text=F.col("family"), current_text=F.col("current_family"),
        )
    )
    return union_all(frames)


def comparable_features(snapshot: Snapshot, current: DataFrame) -> list[FeatureReference]:
    """Reference features present in the current table with an unchanged type family."""
    kinds = {f.name: dtype_family(f.dataType) for f in current.schema}
    return [f for f in snapshot.features if kinds.get(f.feature) == dtype_family(f.dtype)]


#: Marks the rows of :func:`facts` that count rows and positives instead of a feature's values.
ROWS = ""


@dataclass(frozen=True)
class Facts:
    """What detection and attribution read: one grouped count of a current table, or of several.

    ``counts`` is a stage table with ``[tags,] segment, feature, bin, n, total``: finite values by
    reference bin and their sum, missing values under a null bin, and rows with their positives under
    the feature ``ROWS``.  ``present`` lists the tags of every table with the features that are
    comparable in it; without tags that is one entry.
    """

    counts: DataFrame
    present: tuple[tuple[tuple[str, ...], tuple[FeatureReference, ...]], ...]
    tags: tuple[str, ...] = ()

    @property
    def features(self) -> list[FeatureReference]:
        """All features that are comparable in any table."""
        return list({f.feature: f for _, features in self.present for f in features}.values())

    def reference(self, columns: str, row) -> DataFrame:
        """Literal rows for every table and comparable feature; ``row`` gives those of one feature."""
        rows = [(*tag, *r) for tag, features in self.present for f in features for r in row(f)]
        names = ", ".join([*(f"{t} string" for t in self.tags), columns])
        return self.counts.sparkSession.createDataFrame(rows, names)


def long_facts(
    snapshot: Snapshot, current: DataFrame, features: Sequence[FeatureReference], tags: Sequence[str] = ()
) -> DataFrame:
    """The rows behind :func:`facts`: ``[tags,] segment, feature, bin, v``, one per row and feature."""
    roles, columns = snapshot.roles, set(current.columns)
    none = F.lit(None).cast("string")
    segment = F.col(roles.segment).cast("string") if roles.segment in columns else none
    bad = F.coalesce(F.col(roles.target) == 1, F.lit(False)) if roles.target in columns else F.lit(False)
    names = [f.feature for f in features]
    clean = current.select(
        *tags, segment.alias("segment"), bad.cast("double").alias("_bad"), *[finite(c).alias(f"v_{c}") for c in names]
    )
    empty = F.lit(None).cast("int")
    values = [F.struct(empty.alias("bin"), F.col("_bad").alias("v")).alias("v_")]
    for f in features:
        inner = list(f.edges[1:-1])
        place = bucket_of(f"v_{f.feature}", inner) if inner else F.when(F.col(f"v_{f.feature}").isNotNull(), F.lit(0))
        values.append(F.struct(place.cast("int").alias("bin"), F.col(f"v_{f.feature}").alias("v")).alias(f"v_{f.feature}"))
    long = clean.select(*tags, "segment", *values)
    long = long.unpivot([*tags, "segment"], ["v_", *[f"v_{c}" for c in names]], "feature", "x")
    return long.select(*tags, "segment", F.expr("substring(feature, 3)").alias("feature"), "x.bin", "x.v")


def counted_facts(long: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """Counts and sums of the rows of :func:`long_facts`, as a stage table."""
    grouped = long.groupBy(*tags, "segment", "feature", "bin")
    return staged(grouped.agg(F.count("*").alias("n"), F.sum("v").alias("total")), "facts")


def facts(snapshot: Snapshot, current: DataFrame) -> Facts:
    """One pass over a current table for all its alerts and causes."""
    features = comparable_features(snapshot, current)
    return Facts(counted_facts(long_facts(snapshot, current, features)), (((), tuple(features)),))


def _rows(known: Facts, *by: str) -> DataFrame:
    """Rows and positives per table (and ``by``)."""
    marks = known.counts.filter(F.col("feature") == ROWS)
    return marks.groupBy(*known.tags, *by).agg(F.sum("n").alias("rows"), F.sum("total").alias("positives"))


def missing_alerts(snapshot: Snapshot, current: DataFrame | Facts) -> DataFrame:
    """Increase of the missing rate against the reference."""
    known = current if isinstance(current, Facts) else facts(snapshot, current)
    tags = known.tags
    ref = known.reference("feature string, reference_rate double", lambda f: [(f.feature, f.missing_rate)])
    missing = known.counts.groupBy(*tags, "feature").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("bin").isNull(), F.col("n")).otherwise(0)).alias("missing")
    )
    joined = ref.join(missing, [*tags, "feature"], "left").fillna(0, ["n", "missing"])
    joined = joined.withColumn("missing_rate", ratio(F.col("missing"), F.col("n")))
    joined = joined.withColumn("delta", F.col("missing_rate") - F.col("reference_rate"))
    severity = two_level(F.col("delta"), MISSING_WARNING, MISSING_CRITICAL)
    return alert_rows(
        joined.filter(severity.isNotNull()), "missingness", "feature", "missing_rate",
        F.col("feature"), severity, reference=F.col("reference_rate"),
        current=F.col("missing_rate"), delta=F.col("delta"), keep=tags,
    )


def psi_floored(snapshot: Snapshot, current: DataFrame | Facts) -> DataFrame:
    """Stability index per feature on the reference bins, probabilities floored at 1e-6."""
    known = current if isinstance(current, Facts) else facts(snapshot, current)
    keys = [*known.tags, "feature"]
    grid = known.reference(
        "feature string, bin int, bins int, ref_n long, ref_total long",
        lambda f: [(f.feature, b, len(f.counts), int(n), int(sum(f.counts))) for b, n in enumerate(f.counts)],
    )
    counted = known.counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    full = grid.join(counted, [*keys, "bin"], "left").fillna(0, ["n"])
    full = full.withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    r = F.greatest(F.col("ref_n") / F.col("ref_total"), F.lit(PROBABILITY_FLOOR))
    c = F.greatest(ratio(F.col("n"), F.col("total")), F.lit(PROBABILITY_FLOOR))
    part = F.when(F.col("total") > 0, (c - r) * F.log(c / r)).otherwise(F.lit(0.0))
    return full.groupBy(*keys, "bins").agg(F.sum(part).alias("psi"))


def distribution_alerts(snapshot: Snapshot, current: DataFrame | Facts) -> DataFrame:
    known = current if isinstance(current, Facts) else facts(snapshot, current)
    psi = F.col("psi")
    severity = two_level(F.abs(psi), PSI_WARNING, PSI_CRITICAL)
    return alert_rows(
        psi_floored(snapshot, known).filter(severity.isNotNull()), "distribution", "feature",
        "psi", F.col("feature"), severity, reference=F.lit(0.0), current=psi, delta=psi,
        evidence={"bucket_count": F.col("bins")}, keep=known.tags,
    )


def family_alerts(snapshot: Snapshot, missing: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """Families with at least two features whose missing rate rose."""
    spark = missing.sparkSession
    sizes: dict[str, int] = {}
    for f in snapshot.features:
        sizes[f.family] = sizes.get(f.family, 0) + 1
    families = spark.createDataFrame(
        [(f.feature, f.family, sizes[f.family]) for f in snapshot.features],
        "feature string, family string, size int",
    )
    grouped = (
        missing.join(families, missing["scope_value"] == families["feature"])
        .groupBy(*tags, "family", "size")
        .agg(
            F.count("*").alias("anomalous"),
            F.max((F.col("severity") == "critical").cast("int")).alias("critical"),
        )
        .filter(F.col("anomalous") >= 2)
    )
    severity = F.when(F.col("critical") == 1, "critical").otherwise("warning")
    return alert_rows(
        grouped, "missingness", "family", "missing_rate", F.col("family"), severity,
        evidence={
            "anomalous_feature_count": F.col("anomalous"),
            "family_feature_count": F.col("size"),
        },
        keep=tags,
    )


def label_alerts(snapshot: Snapshot, current: DataFrame | Facts) -> DataFrame:
    """Absolute change of the positive rate; null targets are not positive."""
    known = current if isinstance(current, Facts) else facts(snapshot, current)
    now = _rows(known).withColumn("rate", F.col("positives") / F.col("rows"))
    delta = F.col("rate") - snapshot.positive_rate
    severity = two_level(F.abs(delta), LABEL_WARNING, LABEL_CRITICAL)
    return alert_rows(
        now.filter(severity.isNotNull()), "label", "dataset", "positive_rate",
        F.lit(snapshot.dataset_id), severity, reference=F.lit(snapshot.positive_rate),
        current=F.col("rate"), delta=delta, keep=known.tags,
    )


def population_alerts(snapshot: Snapshot, current: DataFrame | Facts) -> DataFrame:
    """Share changes of segments; new and vanished segments count when they are large."""
    known = current if isinstance(current, Facts) else facts(snapshot, current)
    tags, minimum = known.tags, snapshot.min_group_size
    now = _rows(known, "segment").withColumn("segment", F.coalesce("segment", F.lit("None")))
    now = now.groupBy(*tags, "segment").agg(F.sum("rows").alias("now"))
    totals = _rows(known).select(*tags, F.col("rows").alias("now_total"))
    ref = snapshot.segments.withColumnRenamed("n", "ref")
    if tags:
        # A handful of tables times the segments of the reference.
        named = F.array(*[F.struct(*[F.lit(v).alias(t) for t, v in zip(tags, tag)]) for tag, _ in known.present])
        ref = ref.select(F.explode(named).alias("_t"), "segment", "ref").select("_t.*", "segment", "ref")
    joined = now.join(ref, [*tags, "segment"], "full_outer").fillna(0, ["now", "ref"])
    if tags:
        joined = joined.join(totals, list(tags))
    else:
        total = totals.first()
        joined = joined.withColumn("now_total", F.lit(total["now_total"] if total else None).cast("long"))
    r, c = F.col("ref"), F.col("now")
    eligible = (
        ((r == 0) & (c >= minimum)) | ((c == 0) & (r >= minimum)) | ((r >= minimum) & (c >= minimum))
    )
    r_share = r / F.lit(snapshot.row_count)
    c_share = c / F.col("now_total")
    shares = (
        joined.filter(eligible & (F.col("now_total") > 0) & F.lit(snapshot.row_count > 0))
        .withColumns({"r_share": r_share, "c_share": c_share})
        .withColumn("delta", F.col("c_share") - F.col("r_share"))
        .filter(F.abs("delta") >= SHARE_WARNING)
    )
    return alert_rows(
        shares, "population", "institution", "share", F.col("segment"), F.lit("warning"),
        reference=F.col("r_share"), current=F.col("c_share"), delta=F.col("delta"), keep=tags,
    )


def rule_decay_alerts(reference: DataFrame, current: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """Loss of lift of rules known on both sides (``rule_id, lift`` tables; the current one may be tagged)."""
    joined = reference.select("rule_id", F.col("lift").alias("ref")).join(
        current.select(*tags, "rule_id", F.col("lift").alias("now")), "rule_id"
    )
    decay = (F.col("ref") - F.col("now")) / F.col("ref")
    rows = joined.filter(F.col("ref") > 0).withColumn("decay", decay)
    severity = two_level(F.col("decay"), DECAY_WARNING, DECAY_CRITICAL)
    return alert_rows(
        rows.filter(severity.isNotNull()), "rule_decay", "rule", "lift_decay", F.col("rule_id"),
        severity, reference=F.col("ref"), current=F.col("now"), delta=F.col("decay"), keep=tags,
    )


def detect(
    snapshot: Snapshot,
    current: DataFrame,
    current_rules: DataFrame | None = None,
    known: Facts | None = None,
) -> DataFrame:
    """All alerts of a current table against a reference snapshot.

    The rows are read once, for :func:`facts`; with ``known`` they are not read at all.
    """
    known = facts(snapshot, current) if known is None else known
    frames = [schema_alerts(snapshot, current), *value_alerts(snapshot, known)]
    if snapshot.roles.target in current.columns:
        frames.append(label_alerts(snapshot, known))
    if snapshot.roles.segment in current.columns:
        frames.append(population_alerts(snapshot, known))
    if snapshot.rules is not None and current_rules is not None:
        frames.append(rule_decay_alerts(snapshot.rules, current_rules))
    return union_all(frames)


def value_alerts(snapshot: Snapshot, known: Facts) -> list[DataFrame]:
    """Alerts about the values of features and families."""
    # Anomalous features only; the family alerts read them again.
    missing = small_table(missing_alerts(snapshot, known))
    return [missing, distribution_alerts(snapshot, known), family_alerts(snapshot, missing, known.tags)]


def alert_order(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("alert_type", "scope", "scope_value", "metric")


def alert_overview(alerts: DataFrame) -> DataFrame:
    """Alerts per type (zeros included), split into global and segment alerts."""
    types = alerts.sparkSession.createDataFrame([(t,) for t in ALERT_TYPES], "alert_type string")
    counts = alerts.groupBy("alert_type").agg(
        F.count("*").alias("alert_count"),
        F.count_if(F.col("scope") != "institution").alias("global_count"),
        F.count_if(F.col("scope") == "institution").alias("institution_count"),
    )
    return types.join(counts, "alert_type", "left").fillna(0)


# --- attribution ------------------------------------------------------------------------


def eligible_segments(current: DataFrame, segment: str, min_group_size: int) -> DataFrame:
    """Labelled segments that are large enough, with their share of all rows."""
    counts = staged(
        current.groupBy(F.col(segment).cast("string").alias("segment")).agg(F.count("*").alias("n")),
        "segments",
    )
    return counts.withColumn("share", F.col("n") / F.lit(counts.agg(F.sum("n")).first()[0])).filter(
        F.col("segment").isNotNull() & (F.col("n") >= min_group_size)
    )


def segment_contributions(
    snapshot: Snapshot, current: DataFrame | Facts, features: Sequence[str]
) -> DataFrame:
    """Per feature and eligible segment: missing-rate and centre shift times share.

    The reference side is a small table of edges and rates.
    """
    if isinstance(current, Facts):
        known = current
    else:
        # Every feature of the reference that the table has counts here, whatever its type family.
        wanted = [f for f in snapshot.features if f.feature in set(features) & set(current.columns)]
        known = Facts(counted_facts(long_facts(snapshot, current, wanted)), (((), tuple(wanted)),))
    tags = known.tags
    finite_n = F.sum(F.when(F.col("bin").isNotNull(), F.col("n")).otherwise(0))
    rates = known.counts.groupBy(*tags, "segment", "feature").agg(
        F.sum("n").alias("n"),
        finite_n.alias("n_finite"),
        F.sum(F.when(F.col("bin").isNotNull(), F.col("total"))).alias("total"),
    )
    rates = rates.filter(F.col("feature").isin([f for f in features]) & (F.col("feature") != ROWS))
    ref = known.reference(
        "feature string, family string, ref_missing double, ref_center double",
        lambda f: [(f.feature, f.family, f.missing_rate, sum(f.edges) / len(f.edges) if f.edges else 0.0)],
    )
    whole = F.sum("n").over(W.partitionBy(*tags, "feature"))
    missing = ratio(F.col("n") - F.col("n_finite"), F.col("n"))
    center = F.coalesce(F.col("total") / F.nullif("n_finite", F.lit(0)), F.lit(0.0))
    return (
        rates.withColumns({"share": F.col("n") / whole, "missing_rate": missing, "center": center})
        .filter(F.col("segment").isNotNull() & (F.col("n") >= snapshot.min_group_size))
        .join(ref, [*tags, "feature"])
        .select(
            *tags,
            "feature",
            "family",
            "segment",
            "share",
            "ref_missing",
            "missing_rate",
            (F.abs(F.col("missing_rate") - F.col("ref_missing")) * F.col("share")).alias("missing_part"),
            "ref_center",
            "center",
            (F.abs(F.col("center") - F.col("ref_center")) * F.col("share")).alias("center_part"),
        )
    )


def _causes(df: DataFrame, dimension: str, value: Column, contribution: Column, ref=None, cur=None, tags=()):
    number = F.lit(None).cast("double")
    return df.select(
        *tags,
        "alert_id",
        F.lit(dimension).alias("dimension"),
        value.alias("value"),
        contribution.alias("contribution"),
        (number if ref is None else ref.cast("double")).alias("reference_value"),
        (number if cur is None else cur.cast("double")).alias("current_value"),
    )


def root_causes(
    alerts: DataFrame,
    snapshot: Snapshot,
    current: DataFrame,
    *,
    top_k: int = 3,
    known: Facts | None = None,
) -> DataFrame:
    """Ranked causes per alert: segments, families, features, target, rule or schema.

    ``known`` are the facts of the current table where they are at hand; the rows are read once otherwise.
    With tagged facts, ``alerts`` and the result carry the tags.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    if known is None:
        known = facts(snapshot, current)
    tags = known.tags
    kind = F.col("alert_type")
    one = lambda t: alerts.filter(kind == t)
    size = F.abs(F.coalesce("delta", F.lit(0.0)))
    value, ref, cur = F.col("scope_value"), F.col("reference_value"), F.col("current_value")
    frames = [
        _causes(one("schema"), "schema", value, F.lit(1.0), tags=tags),
        _causes(one("population"), "segment", value, size, ref, cur, tags),
        _causes(one("rule_decay"), "rule", value, size, ref, cur, tags),
        _causes(one("label"), "target", F.lit(snapshot.roles.target), size, ref, cur, tags),
    ]
    roles = snapshot.roles
    if roles.segment in current.columns:
        if roles.target in current.columns:
            frames.append(_label_causes(one("label"), snapshot, known))
        present = [f.feature for f in known.features]
        if present:
            frames += _feature_causes(alerts, segment_contributions(snapshot, known, present), tags)
    ranked = union_all(frames).withColumn(
        "rank",
        F.row_number()
        .over(
            W.partitionBy(*tags, "alert_id").orderBy(
                # Rounded, so that summation order cannot reorder equal parts.
                F.round("contribution", 9).desc(),
                F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension")),
                "value",
            )
        )
        .cast("long"),
    )
    return ranked.filter(F.col("rank") <= top_k)


def _label_causes(alerts: DataFrame, snapshot: Snapshot, known: Facts) -> DataFrame:
    tags = known.tags
    # There is one target, so a table has at most one alert about it.
    ids = alerts.filter("alert_type = 'label'").select(*tags, "alert_id")
    groups, totals = _rows(known, "segment"), _rows(known).select(*tags, F.col("rows").alias("all_rows"))
    if tags:
        joined = groups.join(totals, list(tags)).join(ids, list(tags))
    else:
        total, named = totals.first(), [r["alert_id"] for r in ids.collect()]
        joined = groups.withColumn("all_rows", F.lit(total["all_rows"] if total else 0)).select(
            "*", F.explode(F.array(*[F.lit(x) for x in named]).cast("array<string>")).alias("alert_id")
        )
    joined = joined.withColumn("share", F.col("rows") / F.col("all_rows"))
    joined = joined.filter(F.col("segment").isNotNull() & (F.col("rows") >= snapshot.min_group_size))
    rate = F.col("positives") / F.col("rows")
    base = F.lit(snapshot.positive_rate)
    return _causes(joined, "segment", F.col("segment"), F.abs(rate - base) * F.col("share"), base, rate, tags)


def _feature_causes(alerts: DataFrame, parts: DataFrame, tags: Sequence[str] = ()) -> list[DataFrame]:
    """Causes of feature alerts (missingness, distribution) and of family alerts."""
    features = alerts.filter(F.col("scope") == "feature").select(
        *tags, "alert_id", "alert_type", F.col("scope_value").alias("feature"), "delta"
    )
    frames = []
    for kind, part, ref, cur in (
        ("missingness", "missing_part", "ref_missing", "missing_rate"),
        ("distribution", "center_part", "ref_center", "center"),
    ):
        mine = features.filter(F.col("alert_type") == kind).join(parts, [*tags, "feature"])
        frames.append(
            _causes(mine, "segment", F.col("segment"), F.col(part), F.col(ref), F.col(cur), tags)
        )
        whole = mine.groupBy(*tags, "alert_id", "feature", "family", "delta").agg(F.sum(part).alias("part"))
        frames.append(_causes(whole, "feature", F.col("feature"), F.abs("delta"), tags=tags))
        frames.append(_causes(whole, "family", F.col("family"), F.col("part"), tags=tags))
    family = alerts.filter((F.col("scope") == "family")).select(
        *tags, "alert_id", F.col("scope_value").alias("family")
    )
    mine = family.join(parts, [*tags, "family"])
    part = F.sum("missing_part").alias("part")
    by = {
        "segment": mine.groupBy(*tags, "alert_id", F.col("segment").alias("value")).agg(part),
        "feature": mine.groupBy(*tags, "alert_id", F.col("feature").alias("value")).agg(part),
        "family": mine.groupBy(*tags, "alert_id", F.col("family").alias("value")).agg(part),
    }
    return frames + [
        _causes(df, dimension, F.col("value"), F.col("part"), tags=tags) for dimension, df in by.items()
    ]

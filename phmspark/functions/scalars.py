"""Scalar functions as column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Configurations in the order of severity, their alias, aliases of method names.
CONFIG_ORDER = ("8screws", "7screws", "6screws", "5screws", "4screws", "3screws", "2screws", "1screws", "0screws")
CONFIG_ALIAS = {"1screw": "1screws"}
METHOD_ALIAS = {"lw": "mahalanobis", "ledoit-wolf": "mahalanobis", "mahalanobis": "mahalanobis", "maha": "mahalanobis", "knn": "knn", "k-nn": "knn", "k_nn": "knn"}
ESTIMATORS = ("legacy", "ledoit_wolf", "oas", "mcd")


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def canonical_config(c: Column) -> Column:
    return F.coalesce(_map(CONFIG_ALIAS)[c], c)


def config_rank(c: Column) -> Column:
    return F.coalesce(_map({x: k for k, x in enumerate(CONFIG_ORDER)})[c], F.lit(999))


def canonical_method(c: Column) -> Column:
    """Trimmed, lower-cased and mapped; null for a name that no method has."""
    return _map(METHOD_ALIAS)[F.lower(F.trim(c))]


def resolved(method: Column, confidence: Column, estimator: Column, neighbours: Column) -> Column:
    """error (null if there is none: the first parameter that is not allowed), method_id, effective parameters by name,
    and ignored ones with the reason, of a requested configuration. Without a valid one all but the error is null."""
    kind = canonical_method(method)
    error = (
        F.when(kind.isNull(), "openset_method")
        .when(confidence.isNull() | F.isnan(confidence) | (confidence <= 0) | (confidence >= 1), "confidence")
        .when(neighbours.isNull() | (neighbours < 1), "knn_neighbors")
        .when(estimator.isNull() | ~estimator.isin(*ESTIMATORS), "mahalanobis_method")
    )
    number, text = neighbours.cast("long").cast("string"), lambda x: x.cast("string")
    is_knn = kind == "knn"
    common = [F.lit("confidence"), text(confidence), F.lit("threshold"), F.lit("1.0")]
    effective = F.when(is_knn, F.create_map(*common, F.lit("knn_neighbors"), number)).otherwise(F.create_map(*common, F.lit("mahalanobis_method"), estimator))
    left = lambda name, value, reason: F.array(F.struct(F.lit(name).alias("parameter"), value.alias("value"), F.lit(reason).alias("reason")))
    ignored = F.when(is_knn, left("mahalanobis_method", estimator, "only used by mahalanobis")).otherwise(left("knn_neighbors", number, "only used by knn"))
    name = F.when(is_knn, F.concat(F.lit("knn/k"), number)).otherwise(F.concat(F.lit("mahalanobis/"), estimator))
    good = lambda x: F.when(error.isNull(), x)
    return F.struct(error.alias("error"), good(name).alias("method_id"), good(effective).alias("effective"), good(ignored).alias("ignored"))


def channel_of(name: Column) -> Column:
    """current, x, y, z or delta_t, from a file's name with or without the word Acceleration; null for others."""
    suffix = F.regexp_extract(name, r"_(Current|Delta_T|(?:Acceleration_)?[XYZ])_data$", 1)
    short = F.lower(F.regexp_replace(suffix, "^Acceleration_", ""))
    return F.when(short == "", F.lit(None).cast("string")).otherwise(short)


def dataset_key(motor: Column, rpm: Column) -> Column:
    return F.concat_ws("/", motor, F.regexp_replace(rpm, "rpm$", ""))


def run_key(motor: Column, rpm: Column, seed: Column, method: Column) -> Column:
    return F.format_string("%s_%srpm_seed%d_%s", motor, rpm, seed, method)


def ratio(a: Column, b: Column) -> Column:
    """Null, not an error, where the denominator is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """The scaled double to its nearest whole number, halves away from zero, scaled back. ``F.round`` takes the double's
    shortest decimal instead, and differs where scaling makes or unmakes a half."""
    up = x * F.lit(10.0**digits)
    return F.when(F.abs(up) < float("inf"), F.round(up, 0) / F.lit(10.0**digits)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def gauge(score: Column) -> Column:
    """min(1, 1 / score) in percent."""
    return F.least(F.lit(1.0), 1 / F.greatest(score, F.lit(1e-9))) * 100


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearly(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Equal within the tolerance; two nulls are equal."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)), F.lit(False))


def seconds(text: Column) -> Column:
    """Seconds since the epoch of an ISO time (Z and offsets too) or of a number."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def portable_path(p: Column) -> Column:
    """Relative, with forward slashes, without empty, '.' or '..' parts."""
    return ~(p.rlike(r"^/|^[A-Za-z]:|\\|//") | p.rlike(r"(^|/)\.{1,2}(/|$)") | (p == "") | p.endswith("/"))


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the broken rules, in order; an unknown outcome breaks none."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, and pairs of neighbouring CJK characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    runs = F.regexp_extract_all(text, F.lit("([\\u4e00-\\u9fff]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))

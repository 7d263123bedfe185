"""Audits, joins for reconciliation, set operations and provenance: Q1-Q8, J8-J11, S13, A28, A29, T3-T8, W10, X6-X16."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phmspark.functions import scalars as S
from phmspark.operators import audits, ranking, reconcile, search
from phmspark.plans.base import query, table
from phmspark.sources import audit
from phmspark.sources.scratch import new_path, spread

_LINES = """SELECT l_suppkey AS file, 0 AS pos, CASE WHEN l_suppkey % 5 = 1 THEN 'a,b,b' WHEN l_suppkey % 5 = 2 THEN 'a,c,b' ELSE 'a,b,c' END AS line FROM (SELECT DISTINCT l_suppkey FROM lineitem)
  UNION ALL SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber), l_quantity::BIGINT || ',' || CASE WHEN l_suppkey % 5 = 3 AND l_linenumber = 7 THEN 'x' ELSE l_linenumber::VARCHAR END || CASE WHEN l_suppkey % 5 = 4 AND l_linenumber = 6 THEN '' ELSE ',1' END FROM lineitem"""


@query(
    "q1_schema_audit",
    f"""WITH lines AS ({_LINES}), c AS (SELECT *, string_split(line, ',') AS cs FROM lines),
        r AS (SELECT *, CASE WHEN pos = 0 AND len(cs) <> len(list_distinct(cs)) THEN 1 WHEN pos = 0 AND line <> 'a,b,c' THEN 2 WHEN pos > 0 AND len(cs) <> 3 THEN 3
              WHEN pos > 0 AND len(list_filter(cs, lambda x: try_cast(x AS DOUBLE) IS NULL)) > 0 THEN 4 END AS code FROM c),
        f AS (SELECT file, min(code) AS code, count(*) - 1 AS rows FROM r GROUP BY file)
        SELECT f.file, ['duplicate header', 'header mismatch', 'row width', 'non-numeric'][f.code] AS reason, any_value(f.rows) AS rows, count(r.pos) AS bad, coalesce(min(r.pos), -1)::BIGINT AS first_bad
        FROM f LEFT JOIN r ON r.file = f.file AND r.code = f.code AND r.code >= 3 GROUP BY ALL""",
)
def q1_schema_audit(spark, d):
    """Text files, one for each supplier, with faults of four kinds; each is rejected for the first."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    k = F.col("l_suppkey") % 5
    head = li.select("l_suppkey").distinct().select(F.col("l_suppkey").alias("file"), F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"), F.when(k == 1, "a,b,b").when(k == 2, "a,c,b").otherwise("a,b,c").alias("line"))
    n = F.col("l_linenumber")
    body = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(","), F.when((k == 3) & (n == 7), "x").otherwise(n.cast("string")), F.when((k == 4) & (n == 6), "").otherwise(",1"))
    lines = head.unionByName(li.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("a"), n.alias("b"), body.alias("line"))).withColumn("pos", F.struct("a", "b"))
    found = audits.audit_lines(lines, ["a", "b", "c"], ["file"], "pos", "line")
    return found.select("file", "reason", "rows", "bad", F.coalesce("first_bad", F.lit(-1)).cast("long").alias("first_bad"))


@query(
    "q1_file_audit",
    """WITH l AS (SELECT l_suppkey AS file, l_suppkey % 8 AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem),
       f AS (SELECT file, k, count(*) AS n, count(*) FILTER (i % 4 = 1) AS bad, list_sort(list(i) FILTER (i % 4 = 1))[1:20] AS places FROM l GROUP BY file, k),
       r AS (SELECT *, CASE WHEN k BETWEEN 4 AND 6 AND bad = 0 THEN NULL ELSE [NULL, 'unreadable_csv', 'duplicate_header', 'ordered_header_mismatch', 'row_width_mismatch', 'non_numeric', 'non_finite', NULL][(k + 1)::INT] END AS reason FROM f)
       SELECT file, CASE WHEN reason IS NULL THEN 'VERIFIED' ELSE 'REJECTED' END AS status, reason, CASE k WHEN 1 THEN 0 ELSE n END AS rows, CASE WHEN reason IS NULL OR k = 1 THEN 0 WHEN k < 4 THEN n ELSE bad END AS rejected_rows,
         CASE WHEN reason IS NOT NULL AND k > 3 THEN array_to_string(places, ',') ELSE '' END AS row_indices, CASE WHEN reason IS NULL THEN CASE k WHEN 7 THEN 'second' ELSE 'first' END END AS schema_version FROM r""",
)
def q1_file_audit(spark, d):
    """Feature files, one for each supplier, written with faults of six kinds (two headers are registered) and audited as
    bytes."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), "l_orderkey", "l_linenumber", "l_quantity").repartition(parts, "file")
    k = F.col("file") % 8
    i = F.row_number().over(Window.partitionBy("file").orderBy("l_orderkey", "l_linenumber")) - 1  # rows of one file
    odd = i % 4 == 1
    cells = F.concat_ws(",", F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string"))
    last = F.when(odd & (k == 5), ",x").when(odd & (k == 6), ",inf").when(odd & (k == 4), "").when((k == 7), ',"1"').otherwise(",1")
    body = F.concat(cells, last, F.when((k == 1) & (i == 0), ',"').otherwise(""))
    heads = F.when(k == 2, "a,b,b").when(k == 3, "a,c,b").when(k == 7, "a,b,d").otherwise("a,b,c")
    # The header rides with the first row: of a union Spark may leave out the shuffle, and header and rows go to two files
    lines = li.select("file", i.alias("pos"), body.alias("body"), heads.alias("head"))
    lines = lines.select("file", "pos", F.posexplode(F.when(F.col("pos") == 0, F.array("head", "body")).otherwise(F.array("body"))).alias("at", "value"))
    path = new_path(spark, "feature-files")
    files = lines.sortWithinPartitions("file", "pos", "at").select("file", "value").write.partitionBy("file")
    files.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)  # tasks put their files in place, not the driver one by one
    found = audit.audit_files(spark, path, {"first": ["a", "b", "c"], "second": ["a", "b", "d"]})
    file = F.regexp_extract("file", r"file=(\d+)/", 1).cast("long")
    return found.select(file.alias("file"), "status", "reason", "rows", "rejected_rows", F.array_join("row_indices", ",").alias("row_indices"), "schema_version")


@query(
    "q2_coverage",
    """SELECT user_id, array_to_string(list_sort(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(s, x))), ',') AS missing,
       array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(['click', 'purchase', 'view'], x))), ',') AS extra, list_contains(s, 'view') AS usable
       FROM (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY 1)""",
)
def q2_coverage(spark, d):
    found = audits.audit_coverage(table(spark, d, "events").select("user_id", "event_type"), ["user_id"], "event_type", ["click", "purchase", "view"], "view")
    return found.select("user_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "usable")


@query(
    "q3_shape_agreement",
    "SELECT user_id, count(*) AS channels, count(DISTINCT n) AS shapes, count(DISTINCT n) = 1 AS agree FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1",
)
def q3_shape_agreement(spark, d):
    """Channels of a configuration must have as many samples each."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.count("*").alias("channels"), F.count_distinct("n").alias("shapes")).withColumn("agree", F.col("shapes") == 1)


_REC = "SELECT event_id, value / 100 AS health, CASE WHEN event_id % 11 = 0 THEN 0.5 ELSE 1 - value / 100 END AS degradation, CASE WHEN event_id % 13 = 0 THEN 2.0 ELSE 0.25 END AS confidence, 0.75 AS uncertainty, event_type AS type FROM events"


@query(
    "q4_record_rules",
    f"""WITH r AS ({_REC}), v AS (SELECT unnest(list_filter([CASE WHEN health NOT BETWEEN 0 AND 1 THEN 'health range' END, CASE WHEN abs(degradation - (1 - health)) > 1e-9 THEN 'degradation' END,
        CASE WHEN abs(confidence + uncertainty - 1) > 1e-9 THEN 'confidence' END, CASE WHEN type NOT IN ('click', 'view', 'purchase') THEN 'type' END], lambda x: x IS NOT NULL)) AS rule FROM r) SELECT rule, count(*) AS n FROM v GROUP BY 1""",
)
def q4_record_rules(spark, d):
    """Broken cross-field rules of health records, counted."""
    e = table(spark, d, "events")
    h, i = F.col("value") / 100, F.col("event_id")
    degradation, confidence = F.when(i % 11 == 0, 0.5).otherwise(1 - h), F.when(i % 13 == 0, 2.0).otherwise(0.25)
    rules = {"health range": ~h.between(0, 1), "degradation": F.abs(degradation - (1 - h)) > 1e-9, "confidence": F.abs(confidence + 0.75 - 1) > 1e-9, "type": ~F.col("event_type").isin("click", "view", "purchase")}
    return e.select(F.explode(S.violations(rules)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "q5_metric_ranges",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IS NULL OR l_discount IS NULL THEN 'missing' WHEN l_linenumber % 7 = 0 THEN 'bad denominator' WHEN l_discount * 20 > 1 THEN 'out of range' ELSE 'ok' END AS status FROM lineitem",
)
def q5_metric_ranges(spark, d):
    """Whether a ratio is present, finite, in [0, 1] and over a positive denominator."""
    li = table(spark, d, "lineitem")
    value, below = F.col("l_discount") * 20, F.when(F.col("l_linenumber") % 7 == 0, 0).otherwise(F.col("l_quantity"))
    status = F.when(value.isNull() | below.isNull(), "missing").when(below <= 0, "bad denominator").when(F.isnan(value) | (value > 1) | (value < 0), "out of range").otherwise("ok")
    return li.select("l_orderkey", "l_linenumber", status.alias("status"))


@query(
    "q6_leakage",
    """WITH p AS (SELECT user_id, ts, CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM events),
       g AS (SELECT user_id FROM p WHERE part = 'train' INTERSECT SELECT user_id FROM p WHERE part = 'test')
       SELECT (SELECT count(*) FROM g) AS shared_groups, epoch_us(max(ts) FILTER (part = 'train')) AS train_end, epoch_us(min(ts) FILTER (part = 'test')) AS test_start,
       max(ts) FILTER (part = 'train') < min(ts) FILTER (part = 'test') AS in_order FROM p""",
)
def q6_leakage(spark, d):
    """Groups in both parts, and whether training ends before the test begins."""
    p = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 5 == 0, "test").otherwise("train").alias("part"))
    shared = p.filter("part = 'train'").select("user_id").intersect(p.filter("part = 'test'").select("user_id")).agg(F.count("*").alias("shared_groups"))
    train, test = F.max(F.when(F.col("part") == "train", F.col("ts"))), F.min(F.when(F.col("part") == "test", F.col("ts")))
    times = p.agg(F.unix_micros(train).alias("train_end"), F.unix_micros(test).alias("test_start"), (train < test).alias("in_order"))
    return shared.crossJoin(times)  # one row each


@query("q7_duplicates", "SELECT l_returnflag, count(*) AS attempts, count(DISTINCT (l_quantity, l_discount, l_tax)) AS stored FROM lineitem GROUP BY 1")
def q7_duplicates(spark, d):
    """Equal vectors are stored once and only counted after."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    once = li.groupBy("l_returnflag", "l_quantity", "l_discount", "l_tax").agg(F.count("*").alias("n"))
    return once.groupBy("l_returnflag").agg(F.sum("n").alias("attempts"), F.count("*").alias("stored"))


@query(
    "q8_role_audit",
    """WITH v AS (SELECT vec_id, label FROM embeddings), r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM v),
       x AS (SELECT label, vec_id, n, CASE WHEN r < floor(0.6 * n) THEN 'train' WHEN r < floor(0.6 * n) + greatest(1, floor(0.2 * n)) THEN 'cal' ELSE 'holdout' END AS role FROM r)
       SELECT label, role, count(*) AS rows, min(vec_id) AS first_id, max(vec_id) AS last_id, bool_and(n >= 10) AS enough FROM x GROUP BY ALL""",
)
def q8_role_audit(spark, d):
    e = ranking.with_role(table(spark, d, "embeddings").select("vec_id", "label"), ["label"], "vec_id")
    return e.groupBy("label", "role").agg(F.count("*").alias("rows"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.bool_and(F.col("n") >= 10).alias("enough"))


@query(
    "j8_paired_streams",
    """SELECT event_type, count(*) AS pairs, count(*) FILTER (a <> b) AS mismatches, array_to_string(list(event_id ORDER BY event_id) FILTER (a <> b)[1:20], ',') AS first_ids
       FROM (SELECT event_id, event_type, round(value, 1) AS a, round(value + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END, 1) AS b FROM events) GROUP BY 1""",
)
def j8_paired_streams(spark, d):
    """Two recordings of one stream held against each other; the first 20 differences of each kind are told."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    left = e.withColumn("x", F.round("value", 1))
    right = e.select("event_id", F.round(F.col("value") + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0), 1).alias("x"))
    both = reconcile.compare_ids(left, right, ["event_id"], "x").join(e.select("event_id", "event_type"), "event_id")
    totals = both.groupBy("event_type").agg(F.count("*").alias("pairs"), F.count_if(F.col("status") != "same").alias("mismatches"))
    w = Window.partitionBy("event_type").orderBy("event_id")
    first = both.filter("status <> 'same'").withColumn("r", F.row_number().over(w)).filter("r <= 20").groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return totals.join(first, "event_type", "left")


@query(
    "j9_manifest",
    """WITH now AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 17 <> 3), said AS (SELECT doc_id, CASE WHEN doc_id % 19 = 5 THEN sha256('') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 23 <> 7)
       SELECT doc_id, CASE WHEN s.sha IS NULL THEN 'unlisted' WHEN n.sha IS NULL THEN 'missing' ELSE 'changed' END AS status FROM now n FULL JOIN said s USING (doc_id) WHERE n.sha IS DISTINCT FROM s.sha""",
)
def j9_manifest(spark, d):
    """A manifest of digests against the bytes there are."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    said = docs.filter("doc_id % 23 <> 7").withColumn("sha", F.when(F.col("doc_id") % 19 == 5, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")))
    found = reconcile.compare_ids(docs.filter("doc_id % 17 <> 3"), said, ["doc_id"], "sha").filter("status <> 'same'")
    return found.select("doc_id", F.when(F.col("status") == "left_only", "unlisted").when(F.col("status") == "right_only", "missing").otherwise("changed").alias("status"))


_RANGES = "SELECT l_returnflag, l_suppkey AS file, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) - n AS start, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_suppkey) AS stop FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)"


@query("w10_origin_offsets", f"SELECT l_returnflag, file, start::BIGINT AS start, stop::BIGINT AS stop FROM ({_RANGES})")
def w10_origin_offsets(spark, d):
    """Pool rows [start, stop) of every file, in the order of files."""
    n = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("file")).agg(F.count("*").alias("n"))
    stop = F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("file"))
    return n.withColumn("stop", stop).select("l_returnflag", "file", (F.col("stop") - F.col("n")).alias("start"), "stop")


@query(
    "j10_row_origins",
    f"WITH r AS ({_RANGES}), p AS (SELECT l_returnflag, o AS row_idx FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), LATERAL (SELECT unnest(range(0, n, 7)) AS o)) SELECT p.l_returnflag, row_idx, file, (row_idx - start)::BIGINT AS csv_row FROM p JOIN r ON p.l_returnflag = r.l_returnflag AND row_idx >= start AND row_idx < stop",
)
def j10_row_origins(spark, d):
    """Every seventh pool row back to its file and row there, by a range join."""
    n = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    part = F.lit(700_000).cast("long")  # numbers are made part by part: no array grows with the pool
    parts = n.select("l_returnflag", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))).alias("part"))
    last = F.least(F.col("n") - 1, (F.col("part") + 1) * part - 1)
    asked = parts.repartition("l_returnflag", "part").select("l_returnflag", F.explode(F.sequence(F.col("part") * part, last, F.lit(7).cast("long"))).alias("row_idx"))
    met = reconcile.range_origins(asked, w10_origin_offsets(spark, d), ["l_returnflag"], "row_idx", "start", "stop")
    return met.select("l_returnflag", "row_idx", "file", (F.col("row_idx") - F.col("start")).alias("csv_row"))


@query("j11_known_classes", "SELECT vec_id, label IN (SELECT DISTINCT label FROM embeddings WHERE label % 3 = 0) AS known FROM embeddings")
def j11_known_classes(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    known = e.filter("label % 3 = 0").select("label").distinct()
    return e.join(known, "label", "left_semi").select("vec_id", F.lit(True).alias("known")).unionByName(e.join(known, "label", "left_anti").select("vec_id", F.lit(False).alias("known")))


@query("s13_unseen_content", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL)")
def s13_unseen_content(spark, d):
    """Contents that a manifest of earlier loads does not have."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    manifest = docs.filter("doc_id % 4 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return audits.unseen(docs, manifest, "text").select("doc_id", "sha")


@query("a28_content_duplicates", "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a28_content_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return docs.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query("a29_fingerprint", "SELECT part, count(*) AS n, sha256(string_agg(doc_id || ':' || sha, ',' ORDER BY doc_id)) AS fingerprint FROM (SELECT doc_id, doc_id // 100 AS part, sha256(text) AS sha FROM documents) GROUP BY 1")
def a29_fingerprint(spark, d):
    """One hash of the ordered (id, digest) list of each part of a hundred ids."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    whole = docs.groupBy("part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "sha"))).alias("x"))
    return whole.select("part", "n", F.sha2(F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["doc_id"], r["sha"])), ","), 256).alias("fingerprint"))


@query("t3_balanced_sample", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 200")
def t3_balanced_sample(spark, d):
    """Up to 200 rows of each class, without replacement: sampling is the operator."""
    return ranking.hash_rank(table(spark, d, "embeddings").select("label", "vec_id"), ["label"], "vec_id", seed=5, count=None).filter("r < 200").drop("r")


@query("t4_union_pools", "SELECT kind, count(*) AS n, sum(id) AS ids FROM (SELECT 'row' AS kind, vec_id AS id FROM embeddings UNION ALL SELECT 'document', doc_id FROM documents) GROUP BY 1" )
def t4_union_pools(spark, d):
    a = table(spark, d, "embeddings").select(F.lit("row").alias("kind"), F.col("vec_id").alias("id"))
    b = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("t5_set_difference", "WITH o AS (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 100000), c AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0) SELECT 'only_orders' AS side, id FROM (FROM o EXCEPT FROM c) UNION ALL SELECT 'only_customers', id FROM (FROM c EXCEPT FROM o)")
def t5_set_difference(spark, d):
    """Customers of large orders against customers in credit, both ways."""
    o = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("id"))
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return o.subtract(c).select(F.lit("only_orders").alias("side"), "id").unionByName(c.subtract(o).select(F.lit("only_customers").alias("side"), "id"))


@query("t6_intersection", "SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def t6_intersection(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), "l_returnflag")
    return li.filter("l_returnflag = 'A'").select("id").intersect(li.filter("l_returnflag = 'R'").select("id"))


@query("t7_conditions", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def t7_conditions(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query(
    "t8_section_search",
    """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS terms FROM benchmark), qt AS (SELECT item_id, unnest(terms) AS term FROM q),
       s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(ls[1]), '[a-z0-9]+'))) AS term, 3 AS w FROM s
       UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(array_to_string(ls[2:], chr(10))), '[a-z0-9]+'))), 1 FROM s),
       c AS (SELECT item_id, doc_id, sum(w) AS score FROM qt JOIN t USING (term) GROUP BY 1, 2)
       SELECT item_id, rank, doc_id, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c) WHERE rank <= 3""",
)
def t8_section_search(spark, d):
    """The three sections with the best term overlap for each question; a title's terms count three times."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), S.tokens(F.col("text")).alias("terms"))
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.split("text", "\n", 2).alias("p"))
    told = docs.select(F.col("doc_id").alias("section"), S.tokens(F.col("p")[0]).alias("title"), S.tokens(F.coalesce(F.get("p", F.lit(1)), F.lit(""))).alias("body"))
    found = search.best_sections(asked, told, {"title": 3, "body": 1}, 3)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("section").alias("doc_id"), "score")


@query(
    "x7_portable_paths",
    "SELECT page_id, url, NOT (regexp_matches(p, '^/|^[A-Za-z]:|\\\\|//') OR regexp_matches(p, '(^|/)\\.{1,2}(/|$)') OR p = '' OR p LIKE '%/') AS portable FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'a/../' || page_id ELSE 'runs/' || page_id END AS p FROM pages)",
)
def x7_portable_paths(spark, d):
    i = F.col("page_id")
    p = F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, F.concat(F.lit("a/../"), i.cast("string"))).otherwise(F.concat(F.lit("runs/"), i.cast("string")))
    return table(spark, d, "pages").select("page_id", "url", S.portable_path(p).alias("portable"))


@query("x8_seconds", "SELECT event_id, epoch_us(ts) / 1e6 AS s FROM events")
def x8_seconds(spark, d):
    """ISO text, with Z, or a number as text, to seconds."""
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise((F.unix_micros(ts) / 1e6).cast("decimal(20,6)").cast("string"))
    return table(spark, d, "events").select("event_id", S.seconds(text).alias("s"))


@query("x11_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity + l_linenumber / 8, 2) AS half_even, round_even(l_quantity / 2, 0) AS whole FROM lineitem")
def x11_half_even(spark, d):
    """Rounding for output: halves go to the even neighbour."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") + F.col("l_linenumber") / 8, 2).alias("half_even"), F.bround(F.col("l_quantity") / 2, 0).alias("whole"))


@query("x14_canonical_hash", "SELECT o_orderkey, sha256(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus})::VARCHAR) AS sha FROM orders")
def x14_canonical_hash(spark, d):
    """SHA-256 of a row's canonical JSON: fields in the order of their names, no blanks."""
    names = sorted(("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.to_json(F.struct(*names)), 256).alias("sha"))


@query("x12_nearly_equal", "SELECT l_orderkey, l_linenumber, abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-12) AS same FROM (SELECT *, l_extendedprice AS a, l_extendedprice * (1 + (l_linenumber % 3) * 6e-10) AS b FROM lineitem)")
def x12_nearly_equal(spark, d):
    a = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.nearly(a, a * (1 + (F.col("l_linenumber") % 3) * 6e-10)).alias("same"))


@query("x13_array_math", "SELECT vec_id, round(sqrt(list_inner_product(f, f)), 6) AS norm, list_position(f, list_max(f)) AS argmax, list_position(f, list_min(f)) AS argmin FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)")
def x13_array_math(spark, d):
    f = F.col("embedding").cast("array<double>")
    e = table(spark, d, "embeddings").select("vec_id", f.alias("f"))
    return e.select("vec_id", F.round(S.norm(F.col("f")), 6).alias("norm"), F.array_position("f", F.array_max("f")).cast("int").alias("argmax"), F.array_position("f", F.array_min("f")).cast("int").alias("argmin"))


@query("x15_json_paths", "SELECT event_id, '/' || k AS path, json_extract_string(props, '$.' || k) AS x FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def x15_json_paths(spark, d):
    """Fields of a JSON object as rows of path and text."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("k", "x")).select("event_id", F.concat(F.lit("/"), "k").alias("path"), "x")


@query("x16_finite_json", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS x FROM lineitem")
def x16_finite_json(spark, d):
    """Not-a-number and infinite become null before anything is written as JSON."""
    t, q = F.col("l_tax"), F.col("l_discount")
    x = F.when((q == 0) & (t == 0), float("nan")).when(q == 0, float("inf")).otherwise(t / F.nullif(q, F.lit(0.0)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.finite_or_null(x), 6).alias("x"))

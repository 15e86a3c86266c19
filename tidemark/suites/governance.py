"""Labels, policies, licences, consent, access, tenancy, erasure and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import redact, subject_digest
from tidemark.operators import govern as v
from tidemark.operators.graph import column_ancestry, reach
from tidemark.suites import day, digits, long, table
from tidemark.suites.graphs import part_edges

SALT = "fixed-salt"


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    """Column edges of a chain of tables: part k's price feeds its children's cost, a key stays a key."""
    e = part_edges(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    pairs = F.explode(F.array(F.struct(F.lit("key").alias("a"), F.lit("key").alias("b")), F.struct(F.lit("price").alias("a"), F.lit("cost").alias("b")), F.struct(F.lit("cost").alias("a"), F.lit("price").alias("b"))))
    return e.select("src", "dst", pairs.alias("p")).select("src", F.col("p.a").alias("src_col"), "dst", F.col("p.b").alias("dst_col"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_partkey <= 3").select(F.col("p_partkey").cast("string").alias("ds"))
    a = p.select("ds", F.lit("key").alias("col"), F.lit("identifier").alias("label"), F.lit(0.9).alias("confidence"))
    return a.unionByName(p.where("ds = '2'").select("ds", F.lit("price").alias("col"), F.lit("money").alias("label"), F.lit(0.6).alias("confidence")))


def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return v.propagate_labels(_labels(spark, sf), _columns(spark, sf)).select("ds", "col", "label", digits("confidence", 4).alias("confidence"))


def policy_violations(spark: SparkSession, sf: str) -> DataFrame:
    policies = table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("ds"), F.lit("money").alias("forbid"))
    return v.violations(v.propagate_labels(_labels(spark, sf), _columns(spark, sf)), policies, 0.5).select("ds", "col", "label")


def unmet_requirements(spark: SparkSession, sf: str) -> DataFrame:
    required = table(spark, sf, "part").where("p_partkey % 9 = 5").select(F.col("p_partkey").cast("string").alias("ds"), F.lit("money").alias("label"))
    return v.unmet(v.propagate_labels(_labels(spark, sf), _columns(spark, sf)), required)


def column_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return column_ancestry(_columns(spark, sf), "96", "price").select("node", long("depth").alias("depth"))


#: Columns as systems name them: name, type, and what stands for their least and greatest value.
SEEN_COLUMNS = (
    ("email_address", "string", "p_name", "p_name"), ("mail", "bigint", None, None), ("client_ip", "string", None, None), ("latitude", "double", "-p_size", "p_size"), ("lat", "double", "p_size", "p_size + 4000"), ("price_cents", "bigint", "p_size", "p_size * 100"),
    ("fee_minor", "int", "p_size + 0.5", "p_size + 9"), ("total", "double", "p_size", "p_retailprice"), ("total", "string", "p_brand", "p_brand"), ("Surname", "string", "p_brand", "p_name"), ("birth_date", "date", None, None), ("customer_id", "bigint", "p_partkey", "p_partkey"),
    ("currency", "string", None, None), ("address", "string", None, None), ("email_sent", "boolean", None, None), ("notes", "string", None, None),
)


def name_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is a table of one column, named as one of those above and profiled by what the part has."""
    text = lambda e: F.expr(f"cast({e or 'null'} as string)")
    seen = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("dtype"), text(lo).alias("min"), text(hi).alias("max")) for n, t, lo, hi in SEEN_COLUMNS])
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("ds"), F.get(seen, (F.col("p_partkey") % len(SEEN_COLUMNS)).cast("int")).alias("c"))
    return v.name_labels(rows.select("ds", "c.*")).select("ds", "name", "label", digits("confidence", 4).alias("confidence"))


def licence_propagation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    commercial = F.when(k % 7 == 0, F.lit(False)).when(k % 5 != 0, F.lit(True))
    own = table(spark, sf, "part").where("p_partkey >= 2").select(k.alias("node"), commercial.alias("commercial"), (k % 11 == 0).alias("share_alike"))
    return v.propagate_licences(part_edges(spark, sf), own)


def purpose_intersection(spark: SparkSession, sf: str) -> DataFrame:
    every = F.array(F.lit("ads"), F.lit("analytics"), F.lit("research"))
    p = table(spark, sf, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("node"), F.posexplode(every).alias("i", "purpose")).where((F.col("i") + F.col("node")) % 5 != 0)
    return v.permitted_purposes(part_edges(spark, sf), p.select("node", "purpose"))


def consent_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose consent, 900 days from their first order, had ended by their last."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    end = F.date_add(F.to_date("a"), 900)
    return g.where(end < F.to_date("b")).select("o_custkey", F.date_format(end, "yyyy-MM-dd").alias("expired"))


def residency_breaches(spark: SparkSession, sf: str) -> DataFrame:
    """Line items whose supplier is of another region than the customer, by region pair."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("home"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("held"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.where("home <> held").groupBy("home", "held").agg(F.count("*").alias("n"))


def k_anonymity(spark: SparkSession, sf: str) -> DataFrame:
    k = v.k_anonymity(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])
    return k.select("n_groups", "k", "n_singled_out")


def singling_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").withColumn("bal", F.floor(F.col("s_acctbal") / 1000))
    alone = rows.groupBy("s_nationkey", "bal").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("s_suppkey")).where("n = 1")
    return alone.select("s_suppkey")


def k_upper_bound(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.observe import profile

    rows = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment")
    return v.k_upper_bound(profile(rows), ["c_nationkey", "c_mktsegment"])


def linkage_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Brands and sizes of parts that together single out more parts than either kind of group alone."""
    p = table(spark, sf, "part")
    one = lambda cols: p.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 1).alias("alone"))
    rows = [one(c).select(F.lit("+".join(c)).alias("quasi"), "alone") for c in (["p_brand"], ["p_size"], ["p_brand", "p_size"])]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _owners(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_partkey % 10 <> 9").select(F.col("p_partkey").alias("node"), F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string")).alias("tenant"))


def tenant_crossings(spark: SparkSession, sf: str) -> DataFrame:
    grants = spark.createDataFrame([("t1", "t2"), ("t0", "t0")], "from_tenant string, to_tenant string")
    return v.crossings(part_edges(spark, sf), _owners(spark, sf), grants).select("src", "dst", "from_tenant", "to_tenant")


def rbac_decisions(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "analyst").otherwise("intern").alias("principal"), F.lit("read").alias("action"), F.concat(F.lit("gold."), F.lower("c_mktsegment")).alias("ds"), (F.col("c_custkey") % 3).cast("int").alias("sensitivity"))
    grants = spark.createDataFrame([("analyst", "read", "^gold\\..*$", 2, "allow"), ("intern", "read", "^gold\\.b.*$", 1, "allow"), ("intern", "read", "^gold\\.build.*$", 9, "deny"), ("intern", "write", "^.*$", 9, "allow")], "principal string, action string, pattern string, ceiling int, effect string")
    return v.decide(requests, grants).select("id", "decision")


def rbac_inherited(spark: SparkSession, sf: str) -> DataFrame:
    """Customers have their nation's role, which inherits its region's; the first three regions inherit each other in a ring."""
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("principal"), F.concat(F.lit("n"), "c_nationkey").alias("role"))
    inherits = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("role"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("r"))
    ring = region.where("r < 3").select(F.concat(F.lit("r"), "r").alias("role"), F.concat(F.lit("r"), (F.col("r") + 1) % 3).alias("parent"))
    grants = region.select(F.concat(F.lit("r"), "r").alias("role"), F.lit("read").alias("action"), F.concat(F.lit("^gold\\.r"), "r", F.lit("$")).alias("pattern"), (F.col("r") % 3).cast("int").alias("ceiling"), F.when(F.col("r") == 4, "deny").otherwise("allow").alias("effect"))
    held = v.inherited_grants(members, inherits.unionByName(ring), grants)
    k = F.col("c_custkey")
    requests = table(spark, sf, "customer").select(k.alias("id"), k.alias("principal"), F.lit("read").alias("action"), F.concat(F.lit("gold.r"), k % 5).alias("ds"), (k % 2).cast("int").alias("sensitivity"))
    return v.decide(requests, held).select("id", "decision")


def column_redaction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", redact(F.col("c_name"), 4).alias("c_name"))


def subject_digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", subject_digest(F.col("c_custkey"), "c_custkey", SALT).alias("digest"))


def erasure_locations(spark: SparkSession, sf: str) -> DataFrame:
    holders = table(spark, sf, "part").where("p_partkey in (5, 9)").select(F.col("p_partkey").alias("node"))
    return v.locate(part_edges(spark, sf), holders)


def _sealed(spark: SparkSession, sf: str) -> DataFrame:
    """A hash chain for each user and day of events, in order; each digest is of the one before and the body."""
    e = table(spark, sf, "events").groupBy("user_id", day("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("log"))
    link = lambda before, body: F.sha2(F.concat_ws("\x1f", before, body), 256)
    none = F.array().cast("array<string>")
    head = lambda out: F.when(F.size(out) > 0, F.element_at(out, -1)).otherwise(F.lit(""))
    chained = e.withColumn("digests", F.aggregate("log", none, lambda out, x: F.concat(out, F.array(link(head(out), x["event_type"])))))
    rows = chained.select("user_id", "day", "digests", F.posexplode("log").alias("at", "x"))
    before = F.when(F.col("at") > 0, F.get("digests", F.col("at") - 1)).otherwise(F.lit(""))
    return rows.select(F.concat_ws("/", "user_id", "day").alias("shard"), F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("body"), (F.col("at") + 1).alias("position"), before.alias("previous"), F.get("digests", F.col("at")).alias("digest"))


def audit_chain_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """After sealing, every 40th body was changed, every 55th link overwritten and every 70th row removed."""
    log = _sealed(spark, sf).where("event_id % 70 <> 0").withColumn("body", F.when(F.col("event_id") % 40 == 0, F.lit("forged")).otherwise(F.col("body"))).withColumn("previous", F.when(F.col("event_id") % 55 == 0, F.lit("x")).otherwise(F.col("previous")))
    return v.chain_breaks(log, "position", "body", "previous", "digest", "shard").select("shard", long("position").alias("position"), "fault")


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select((F.col("user_id") % 7).alias("actor"), F.col("event_type").alias("action"), F.when(F.col("value") > 50, "big").otherwise("small").alias("outcome"))
    return v.audit_summary(log, ["actor", "action", "outcome"])


def affected_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Assets below the parts that break a licence, with how many of them lie above."""
    bad = table(spark, sf, "part").where("p_partkey % 7 = 0 and p_partkey <= 28").select(F.col("p_partkey").alias("node"))
    return reach(part_edges(spark, sf), bad).groupBy("node").agg(F.count("*").alias("n_sources"))


_NAMES = (label_propagation, policy_violations, unmet_requirements, column_lineage, name_labels, licence_propagation, purpose_intersection, consent_expired, residency_breaches, k_anonymity, singling_out, k_upper_bound, linkage_pairs, tenant_crossings, rbac_decisions, rbac_inherited, column_redaction, subject_digests, erasure_locations, audit_chain_breaks, audit_summary, affected_assets)
QUERIES = {f.__name__: f for f in _NAMES}

_E = """e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey * 2, p_partkey * 2 + 1, p_partkey * 3]) AS dst FROM part)
  WHERE src <> dst AND dst IN (SELECT p_partkey FROM part){more})"""
_ALL = _E.format(more="")
_COLS = "x AS (SELECT src::VARCHAR AS src, a, dst::VARCHAR AS dst, b FROM e, (VALUES ('key', 'key'), ('price', 'cost'), ('cost', 'price')) p(a, b))"
_LABELS = f"""WITH RECURSIVE {_ALL}, {_COLS},
l AS (
  SELECT ds::VARCHAR AS ds, col, label, c::DOUBLE AS c, 0 AS hop FROM (VALUES (0, 'key', 'identifier', 0.9), (1, 'key', 'identifier', 0.9), (2, 'key', 'identifier', 0.9), (3, 'key', 'identifier', 0.9), (2, 'price', 'money', 0.6)) v(ds, col, label, c)
  UNION SELECT x.dst, x.b, label, round_even(c * 0.95::DOUBLE, 4)::DOUBLE, hop + 1 FROM l JOIN x ON x.src = ds AND x.a = col),
m AS (SELECT ds, col, label, max(c) AS confidence FROM l GROUP BY 1, 2, 3)
"""
_ABOVE = f"WITH RECURSIVE {_ALL}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), a AS (SELECT dst AS node, src AS source FROM r UNION SELECT dst, dst FROM e UNION SELECT p_partkey, p_partkey FROM part WHERE {{own}})"
_ALONE = "(SELECT count(*) FROM (SELECT 1 FROM part GROUP BY {} HAVING count(*) = 1))"
ORACLE_SQL = {
    "label_propagation": _LABELS + "SELECT ds, col, label, round(confidence, 4) AS confidence FROM m",
    "policy_violations": _LABELS + "SELECT ds, col, label FROM m WHERE label = 'money' AND confidence >= 0.5 AND ds::BIGINT % 4 = 0",
    "unmet_requirements": _LABELS + "SELECT p_partkey::VARCHAR AS ds, 'money' AS label FROM part WHERE p_partkey % 9 = 5 AND p_partkey::VARCHAR NOT IN (SELECT ds FROM m WHERE label = 'money')",
    "column_lineage": f"WITH RECURSIVE {_ALL}, {_COLS}, r AS (SELECT '96' AS ds, 'price' AS col, 0::BIGINT AS depth UNION SELECT x.src, x.a, depth + 1 FROM r JOIN x ON x.dst = ds AND x.b = col) SELECT ds || '#' || col AS node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1",
    "name_labels": """
SELECT p_partkey::VARCHAR AS ds, name, label, confidence::DOUBLE AS confidence FROM part JOIN (VALUES (0, 'email_address', 'email', 0.75), (0, 'email_address', 'pii', 0.75), (2, 'client_ip', 'ip_address', 0.7), (2, 'client_ip', 'pii', 0.7), (3, 'latitude', 'latitude', 0.75),
  (5, 'price_cents', 'monetary_amount', 0.6), (5, 'price_cents', 'minor_units', 0.95), (6, 'fee_minor', 'monetary_amount', 0.6), (7, 'total', 'monetary_amount', 0.6), (9, 'Surname', 'person_name', 0.7), (9, 'Surname', 'pii', 0.7),
  (10, 'birth_date', 'date_of_birth', 0.8), (10, 'birth_date', 'pii', 0.8), (11, 'customer_id', 'user_identifier', 0.7), (11, 'customer_id', 'pii', 0.7), (12, 'currency', 'currency_code', 0.7), (13, 'address', 'postal_address', 0.65), (13, 'address', 'pii', 0.65)) v(k, name, label, confidence) ON p_partkey % 16 = k""",
    "licence_propagation": _ABOVE.format(own="p_partkey >= 2") + """
SELECT node, CASE WHEN bool_or(source % 7 = 0) THEN false WHEN bool_or(source % 5 = 0) THEN NULL ELSE true END AS commercial, bool_or(source % 11 = 0) AS share_alike FROM a WHERE source >= 2 GROUP BY node""",
    "purpose_intersection": _ABOVE.format(own="p_partkey % 2 = 1") + """,
p AS (SELECT p_partkey AS source, i, purpose FROM part, (VALUES (0, 'ads'), (1, 'analytics'), (2, 'research')) v(i, purpose) WHERE p_partkey % 2 = 1 AND (i + p_partkey) % 5 <> 0),
n AS (SELECT node, count(DISTINCT source) AS n FROM a JOIN (SELECT DISTINCT source FROM p) USING (source) GROUP BY node)
SELECT node, purpose FROM a JOIN p USING (source) JOIN n USING (node) GROUP BY node, purpose, n HAVING count(DISTINCT source) = n""",
    "consent_expired": "SELECT o_custkey, strftime(min(o_orderdate)::DATE + 900, '%Y-%m-%d') AS expired FROM orders GROUP BY 1 HAVING min(o_orderdate)::DATE + 900 < max(o_orderdate)::DATE",
    "residency_breaches": """
WITH n AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT h.r_name AS home, s.r_name AS held, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN n h ON c_nationkey = h.n_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN n s ON s_nationkey = s.n_nationkey WHERE h.r_name <> s.r_name GROUP BY 1, 2""",
    "k_anonymity": "WITH g AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT count(*) AS n_groups, min(n) AS k, count(*) FILTER (n = 1) AS n_singled_out FROM g",
    "singling_out": "SELECT min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey, floor(s_acctbal / 1000) HAVING count(*) = 1",
    "k_upper_bound": "SELECT floor(count(*) / greatest(count(DISTINCT c_nationkey), count(DISTINCT c_mktsegment)))::BIGINT AS k_at_most FROM customer",
    "linkage_pairs": f"SELECT 'p_brand' AS quasi, {_ALONE.format('p_brand')} AS alone UNION ALL SELECT 'p_size', {_ALONE.format('p_size')} UNION ALL SELECT 'p_brand+p_size', {_ALONE.format('p_brand, p_size')}",
    "tenant_crossings": f"""WITH {_ALL} SELECT src, dst, 't' || src % 4 AS from_tenant, 't' || dst % 4 AS to_tenant FROM e WHERE src % 10 <> 9 AND dst % 10 <> 9 AND src % 4 <> dst % 4 AND NOT (src % 4 = 1 AND dst % 4 = 2)""",
    "rbac_decisions": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'allow' WHEN c_mktsegment LIKE 'BUILD%' THEN 'deny' WHEN c_mktsegment LIKE 'B%' THEN CASE WHEN c_custkey % 3 > 1 THEN 'too_sensitive' ELSE 'allow' END ELSE 'no_grant' END AS decision FROM customer""",
    "rbac_inherited": """
WITH RECURSIVE i AS (SELECT 'n' || n_nationkey AS role, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || r_regionkey, 'r' || ((r_regionkey + 1) % 3) FROM region WHERE r_regionkey < 3),
h AS (SELECT role, role AS carried FROM i UNION SELECT h.role, i.parent FROM h JOIN i ON h.carried = i.role),
g AS (SELECT c_custkey, r_regionkey AS r FROM customer JOIN h ON role = 'n' || c_nationkey JOIN region ON carried = 'r' || r_regionkey WHERE r_regionkey = c_custkey % 5)
SELECT c.c_custkey AS id, CASE WHEN r = 4 THEN 'deny' WHEN r IS NULL THEN 'no_grant' WHEN c.c_custkey % 2 > r % 3 THEN 'too_sensitive' ELSE 'allow' END AS decision FROM customer c LEFT JOIN g USING (c_custkey)""",
    "column_redaction": "SELECT c_custkey, left(c_name, 4) || '***' AS c_name FROM customer",
    "subject_digests": f"SELECT c_custkey, sha256(concat_ws(chr(31), '{SALT}', 'c_custkey', c_custkey::VARCHAR)) AS digest FROM customer",
    "erasure_locations": f"WITH RECURSIVE {_ALL}, r AS (SELECT p_partkey AS node FROM part WHERE p_partkey IN (5, 9) UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r",
    "audit_chain_breaks": """
WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS shard, event_id FROM events),
p AS (SELECT *, row_number() OVER w AS position, lag(event_id) OVER w AS before, count(*) FILTER (event_id % 70 = 0) OVER w AS gone FROM e WINDOW w AS (PARTITION BY shard ORDER BY event_id)),
f AS (SELECT shard, position, CASE WHEN event_id % 55 = 0 OR before % 70 = 0 THEN 'link' WHEN event_id % 40 = 0 THEN 'digest' WHEN gone > 0 THEN 'sequence' END AS fault FROM p WHERE event_id % 70 <> 0)
SELECT * FROM f WHERE fault IS NOT NULL""",
    "audit_summary": """
SELECT 'actor' AS dimension, (user_id % 7)::VARCHAR AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'action', event_type, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'outcome', CASE WHEN value > 50 THEN 'big' ELSE 'small' END, count(*) FROM events GROUP BY 2""",
    "affected_assets": f"""WITH RECURSIVE {_ALL}, r AS (SELECT p_partkey AS seed, p_partkey AS node FROM part WHERE p_partkey % 7 = 0 AND p_partkey <= 28 UNION SELECT seed, dst FROM r JOIN e ON src = node)
SELECT node, count(*) AS n_sources FROM r WHERE node <> seed GROUP BY 1""",
}

"""Labels, policies, licences, consent, access, tenancy, erasure and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.graph import HOPS, fold_downstream, reach, spread
from tidemark.session import Growing, many, materialize, shuffled

DAMPING = 0.95

# What a column's name (in lower case) suggests, the types it may have, and how sure that is.
TEXT, REAL = ("string", "utf8"), ("double", "float")
DETECTORS = {
    "email": (r"(^|_)e?_?mail(_|$)", TEXT, 0.75),
    "phone": (r"(^|_)(phone|mobile|msisdn|tel)(_|$)", TEXT, 0.7),
    "national_id": (r"(^|_)(ssn|nino|national_id|tax_id|passport)(_|$)", TEXT, 0.8),
    "date_of_birth": (r"(^|_)(dob|birth_?date|date_of_birth)(_|$)", (), 0.8),
    "person_name": (r"(^|_)(first_name|last_name|full_name|surname|given_name)(_|$)", TEXT, 0.7),
    "postal_address": (r"^address$|(^|_)(street|postcode|post_code|zip_?code|billing_address|shipping_address|postal_address)(_|$)", TEXT, 0.65),
    "ip_address": (r"(^|_)(ip|ip_address|client_ip)(_|$)", TEXT, 0.7),
    "device_id": (r"(^|_)(device_id|idfa|advertising_id)(_|$)", (), 0.7),
    "currency_code": (r"(^|_)(currency|ccy)(_code)?(_|$)", TEXT, 0.7),
    "monetary_amount": (r"(^|_)(amount|price|revenue|cost|total|balance|fee)(_|$)", (*REAL, "decimal", "int"), 0.6),
    "minor_units": (r"_(cents|pence|minor)$", ("int",), 0.85),
    "latitude": (r"(^|_)(lat|latitude)(_|$)", REAL, 0.6),
    "longitude": (r"(^|_)(lon|lng|longitude)(_|$)", REAL, 0.6),
    "user_identifier": (r"(^|_)(user_id|customer_id|account_id|subject_id)(_|$)", (), 0.7),
}
PERSONAL = ("email", "phone", "national_id", "date_of_birth", "person_name", "postal_address", "ip_address", "device_id", "user_identifier")
SUPPORT = 0.15
MOST_SURE = 0.95


def _supports(label: str) -> Column:
    """Whether the range of a column bears a label out: true, false (which refutes it), or null where it says nothing."""
    low, high = F.col("min").try_cast("double"), F.col("max").try_cast("double")
    whole = lambda x: x == F.floor(x)
    return {"latitude": (low >= -90) & (high <= 90), "longitude": (low >= -180) & (high <= 180), "minor_units": whole(low) & whole(high)}.get(label, F.lit(None).cast("boolean"))


def name_labels(columns: DataFrame) -> DataFrame:
    """(ds, name, label, confidence) that names, types and ranges suggest; columns: ds, name, dtype, min, max (texts).

    The rules are a constant, so this is one projection. Any personal label makes the column personal data.
    """
    hits = []
    for label, (pattern, types, sure) in DETECTORS.items():
        fits = F.lower("name").rlike(pattern)
        if types:
            fits = fits & F.lower("dtype").rlike("|".join(types))
        support = _supports(label)
        confidence = F.when(support, F.least(F.lit(MOST_SURE), F.lit(sure + SUPPORT))).otherwise(F.lit(sure))
        hits.append(F.when(fits & F.coalesce(support, F.lit(True)), F.struct(F.lit(label).alias("label"), confidence.alias("confidence"))))
    found = columns.select("ds", "name", F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("found"))
    most = F.array_max(F.transform(F.filter("found", lambda x: x["label"].isin(*PERSONAL)), lambda x: x["confidence"]))
    personal = F.when(most.isNotNull(), F.array(F.struct(F.lit("pii").alias("label"), most.alias("confidence"))))
    return found.select("ds", "name", F.inline(F.concat("found", F.coalesce(personal, F.array().cast("array<struct<label:string,confidence:double>>")))))


#: Stands for a column that is not known.
UNATTRIBUTED = "*"


def propagate_labels(labels: DataFrame, columns: DataFrame) -> DataFrame:
    """(ds, col, label, confidence, confirmed): labels carried along column edges, damped at each hop, the largest kept.

    labels: ds, col, label, confidence and, if there, confirmed: what people have confirmed no
    inference replaces, and its copies further down are inferences. columns: src, src_col, dst, dst_col;
    an edge without columns (nulls) carries every label of its source to the column `*`, and
    `*` goes on over edges of both kinds. A round carries what improved a few hops on and appends
    what that improves, until nothing does; a cycle dies out, as damping improves nothing.
    """
    keys = ["ds", "col", "label"]
    best = lambda df: df.groupBy(*keys).agg(F.max("confidence").alias("confidence"))
    confirmed = F.coalesce("confirmed", F.lit(False)) if "confirmed" in labels.columns else F.lit(False)
    given = materialize(labels.select(*keys, "confidence", confirmed.alias("confirmed")), "labels")
    sure = materialize(best(given.where("confirmed")), "confirmed")
    settled = not sure.isEmpty()
    pairs = columns.select("src", "dst").distinct()
    star = F.lit(UNATTRIBUTED)
    exact = columns.where("src_col is not null").select("src", "src_col", "dst", F.coalesce("dst_col", star).alias("dst_col"))
    loose = materialize(columns.where("src_col is null").select("src", "dst").distinct(), "table-hops")
    detailed = loose.isEmpty()
    if not detailed or not given.where(F.col("col") == star).isEmpty() or not exact.where(F.col("dst_col") == star).isEmpty():
        exact = exact.unionByName(pairs.select("src", star.alias("src_col"), "dst", star.alias("dst_col")))
    exact = materialize(exact.distinct(), "column-hops")
    far = many(exact)
    unsettled = lambda df: df.join(sure.select(*keys), keys, "left_anti") if settled else df
    damped = F.bround(F.col("confidence") * DAMPING, 4).alias("confidence")

    def hop(at: DataFrame) -> DataFrame:
        moved = shuffled(at, far).join(exact, (at["ds"] == exact["src"]) & (at["col"] == exact["src_col"])).select(F.col("dst").alias("ds"), F.col("dst_col").alias("col"), "label", damped)
        if not detailed:
            some = at.where(F.col("col") != star)
            moved = moved.unionByName(some.join(loose, some["ds"] == loose["src"]).select(F.col("dst").alias("ds"), star.alias("col"), "label", damped))
        return unsettled(best(moved))

    known = Growing(unsettled(best(given)).unionByName(sure), "labels")
    front = known.read()
    while not front.isEmpty():
        at, every = front, None
        for _ in range(HOPS):
            at = hop(at)
            every = at if every is None else every.unionByName(at)
        both = every.withColumn("new", F.lit(True)).unionByName(known.read().withColumn("new", F.lit(False)))
        sums = both.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max(F.when(~F.col("new"), F.col("confidence"))).alias("had"), F.bool_or("new").alias("new"))
        front = known.append(sums.where("new and (had is null or confidence > had)"))
    return best(known.read()).join(sure.select(*keys, F.lit(True).alias("confirmed")), keys, "left").select(*keys, "confidence", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def violations(labels: DataFrame, policies: DataFrame, least: float = 0.5) -> DataFrame:
    """(ds, col, label) that a policy of the dataset forbids; policies: ds, forbid. What is confirmed counts whatever its confidence."""
    counts = F.col("confidence") >= least
    counts = counts | F.col("confirmed") if "confirmed" in labels.columns else counts
    return labels.where(counts).join(policies.select("ds", F.col("forbid").alias("label")), ["ds", "label"], "left_semi").select("ds", "col", "label")


def unmet(labels: DataFrame, required: DataFrame) -> DataFrame:
    """(ds, label) that a policy requires and no column has."""
    return required.join(labels.select("ds", "label"), ["ds", "label"], "left_anti")


def _rank(value: Column) -> Column:
    """Three-valued permissions by strictness: false before unknown before true."""
    return F.when(value, 2).when(value.isNull(), 1).otherwise(0)


def propagate_licences(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, commercial, share_alike): the strictest of all sources; share-alike if one asks for it."""
    ranked = own.select("node", _rank(F.col("commercial")).alias("rank"), "share_alike")
    folded = fold_downstream(edges, ranked, {"rank": F.min, "share_alike": F.bool_or})
    return folded.select("node", F.when(F.col("rank") == 2, True).when(F.col("rank") == 0, False).alias("commercial"), "share_alike")


def permitted_purposes(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, purpose) that every declared source of a node allows; own: node, purpose.

    What a source does not allow is carried downstream, one mark for each
    purpose and node: no node meets all its sources.
    """
    every = own.agg(F.collect_set("purpose").alias("every"))  # one row: purposes are few and named by people
    denied = own.groupBy("node").agg(F.collect_set("purpose").alias("has")).crossJoin(every).select("node", F.explode(F.array_except("every", "has")).alias("purpose"))
    below = spread(edges, denied.select(F.concat(F.lit("-"), "purpose").alias("label"), "node").unionByName(own.select(F.lit("+").alias("label"), "node")))
    held = below.groupBy("node").agg(F.bool_or(F.col("label") == "+").alias("declared"), F.collect_set(F.when(F.col("label") != "+", F.substr("label", F.lit(2)))).alias("denied"))
    return held.where("declared").crossJoin(every).select("node", F.explode(F.array_except("every", "denied")).alias("purpose"))


def k_anonymity(df: DataFrame, quasi: list[str]) -> DataFrame:
    """One row: groups, the least group (k), and rows alone in theirs."""
    g = df.groupBy(*quasi).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_groups"), F.min("n").alias("k"), F.count_if(F.col("n") == 1).alias("n_singled_out"))


def k_upper_bound(profile: DataFrame, quasi: list[str]) -> DataFrame:
    """One row: the most that k can be, from rows and distinct counts alone."""
    p = profile.where(F.col("name").isin(quasi)).agg(F.max("row_count").alias("n"), F.max("distinct").alias("d"))
    return p.select(F.floor(F.col("n") / F.col("d")).cast("long").alias("k_at_most"))


def crossings(edges: DataFrame, owners: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """(src, dst, from_tenant, to_tenant): edges between known, different owners without a grant."""
    e = edges.join(owners.select(F.col("node").alias("src"), F.col("tenant").alias("from_tenant")), "src").join(owners.select(F.col("node").alias("dst"), F.col("tenant").alias("to_tenant")), "dst").where("from_tenant <> to_tenant")
    return e if grants is None else e.join(grants, ["from_tenant", "to_tenant"], "left_anti")


def inherited_grants(members: DataFrame, inherits: DataFrame, grants: DataFrame) -> DataFrame:
    """grants (role and what `decide` needs) of each principal, through the roles that its roles inherit, with the role that carried each.

    members: principal, role; inherits: role, parent. A role that inherits itself, however far around, ends there.
    """
    every = members.sparkSession.sql(
        """
        WITH RECURSIVE held(role, carried, path) AS (
          SELECT role, role, array(role) FROM (SELECT DISTINCT role FROM {members})
          UNION ALL
          SELECT h.role, i.parent, concat(h.path, array(i.parent)) FROM held h JOIN {inherits} i ON h.carried = i.role WHERE NOT array_contains(h.path, i.parent)
        )
        SELECT DISTINCT role, carried FROM held
        """,
        members=members.select("role"), inherits=inherits.select("role", "parent"),
    )
    return members.join(every, "role").select("principal", "carried").distinct().join(grants.withColumnRenamed("role", "carried"), "carried")


def decide(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """(requests, decision): deny before allow, a grant below the sensitivity is no grant, nothing is a denial.

    requests: id, principal, action, ds, sensitivity; grants: principal, action, pattern (regular expression), ceiling, effect.
    """
    g = grants.select(F.col("principal").alias("p"), F.col("action").alias("a"), "pattern", "ceiling", "effect")
    hit = requests.join(g, (F.col("principal") == F.col("p")) & (F.col("action") == F.col("a")) & F.expr("rlike(ds, pattern)"), "left")
    rank = F.when(F.col("effect") == "deny", 3).when(F.col("ceiling") < F.col("sensitivity"), 2).when(F.col("effect") == "allow", 1).otherwise(0)
    best = hit.groupBy(*requests.columns).agg(F.max(rank).alias("r"))
    return best.select(*requests.columns, F.when(F.col("r") == 1, "allow").when(F.col("r") == 3, "deny").when(F.col("r") == 2, "too_sensitive").otherwise("no_grant").alias("decision"))


def chain_breaks(log: DataFrame, position: str, body: str, previous: str, digest: str, shard: str | None = None) -> DataFrame:
    """Positions whose digest, link or number is wrong: a hash chain checked in one window pass for each shard."""
    w = (W.partitionBy(shard) if shard else W.partitionBy(F.lit(0))).orderBy(position)
    seen = log.withColumn("_p", F.coalesce(F.lag(digest).over(w), F.lit(""))).withColumn("_n", F.row_number().over(w))
    real = F.sha2(F.concat_ws("\x1f", F.col(previous), F.col(body)), 256)
    why = F.when(F.col(previous) != F.col("_p"), "link").when(F.col(digest) != real, "digest").when(F.col(position) != F.col("_n"), "sequence")
    return seen.select(*([shard] if shard else []), position, why.alias("fault")).where("fault is not null")


def audit_summary(log: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): counts by each column alone, in one pass of grouping sets."""
    sets = [[c] for c in columns]
    g = log.groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("g"))
    full = (1 << len(columns)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        this = F.col("g") == (full ^ (1 << (len(columns) - 1 - i)))
        name, value = F.when(this, F.lit(c)).otherwise(name), F.when(this, F.col(c).cast("string")).otherwise(value)
    return g.select(name.alias("dimension"), value.alias("value"), "n")


def locate(edges: DataFrame, holders: DataFrame) -> DataFrame:
    """Every dataset derived from one that holds the subject, the holders included."""
    return reach(edges, holders.select("node")).select("node").union(holders.select("node")).distinct()

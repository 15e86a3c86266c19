"""The prefix trie of conversations by radix partitioning over dictionary-encoded turns.

Every distinct turn (role, text) gets an integer from a dictionary, and a
conversation is the row of its turns' integers; equal conversations are one row
with a count. The most significant digit of a row is its first turn: a bucket of
rows that share their first d turns is dealt by turn d into smaller buckets, on
the whole cluster, as long as it has more than `local` distinct rows. What all
rows of such a bucket share is passed over at once, so a round is a branching, not a
turn. Smaller buckets are finished where they meet in a task by multikey
quicksort, whose recursion (kept on a stack, so any depth works) emits the nodes.

Sums over subtrees come back from the tasks for the roots of their buckets and
are added up along the few distributed rounds. Texts are shuffled by no step:
a turn is its digest (SHA-256) until the dictionary has it. The members that end at a node
are rendered in ordered runs by many tasks; only the hashing of those runs, which has
to follow their order, is one stream for each node.

Order of turns: by number, null first, equal numbers by role and then by the
digest. A null role or text is an empty one. Rows without a conversation id belong
to none and are left out; repeated rows are turns of their own. An empty table has
no node. Other columns, whatever their names, are not read. A conversation's turn
numbers (a few bytes each, never its texts) are held as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import CRC_TABLE_SQL, crc32_sql
from tidemark.session import materialize

#: Distinct rows that a task finishes by itself.
LOCAL = 250
#: Large buckets up to this number travel to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Ids that one rendered run has at most.
RUN = 4096
FAMILY = 100
HEADS = 6

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


def encode_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): the turns of each conversation in order, as structs of the dictionary's id and the text's code points."""
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    turns = materialize(c.select("conv_id", "turn", "role", digest.alias("digest"), F.length("text").alias("len")), "turns")
    dictionary = materialize(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    placed = F.struct(F.col("turn").isNotNull().alias("set"), "turn", "role", "digest", "id", "len")
    rows = turns.join(dictionary, "digest").groupBy("conv_id").agg(F.sort_array(F.collect_list(placed)).alias("seq"))
    return rows.select("conv_id", F.transform("seq", lambda x: F.struct(x["id"].alias("id"), x["len"].alias("len"))).alias("seq"))


def rebuild(seqs: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(conv_id, seq): each conversation's first h turns replaced by those of its family's first, h from the CRC of its id."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    first = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("family"), F.slice("seq", 1, heads).alias("head"))
    own = seqs.select("conv_id", "seq", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("family"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(seqs.schema["seq"].dataType))
    tail = F.slice("seq", F.col("h") + 1, F.size("seq"))
    return own.join(first, "family", "left").select("conv_id", F.concat(head, tail).alias("seq"))


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        for key, same in groupby(batch.column(0).to_pylist()):
            n = sum(1 for _ in same)
            ids = batch.column(1)[start : start + n].to_pylist()
            runs = [ids[i : i + RUN] for i in range(0, n, RUN)]
            start += n
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(runs), pa.binary()), pa.array([r[0] for r in runs], pa.int64()), pa.array([",".join(map(str, r)) for r in runs], pa.string())], names=["key", "first", "run"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key of runs that come in order; a key may go over batches."""
    held, state = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])
    for batch in batches:
        for key, run in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != held:
                if state:
                    yield row()
                held, state = key, hashlib.sha256(run.encode())
            else:
                state.update(b"," + run.encode())
    if state:
        yield row()


def ends(rows: DataFrame) -> DataFrame:
    """(key, ends): the SHA-256 of each key's ids in numerical order."""
    runs = rows.select("key", "conv_id").repartitionByRange(F.col("key"), F.col("conv_id")).sortWithinPartitions("key", "conv_id").mapInArrow(_rendered, "key binary, first long, run string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")


def multikey(rows: list[tuple[list[int], list[int], int, int, str]], depth: int, parent: int | None) -> list[list]:
    """Nodes (conv_id, depth, parent's conv_id, n_convs, n_children, n_leaves, saved, ends) of the subtree over rows that share `depth` turns; the first is its top.

    rows are (turns, lengths, count, smallest id, ends), all different.
    """
    nodes: list[list] = []
    above: list[int] = []

    def node(members: list[tuple], at: int, up: int, parent_id: int | None) -> int:
        n = sum(m[2] for m in members)
        saved = (n - 1) * members[0][1][at - 1] if at else 0
        nodes.append([min(m[3] for m in members), at, parent_id, n, 0, 0, saved, _NONE])
        above.append(up)
        if up >= 0:
            nodes[up][4] += 1
        return len(nodes) - 1

    stack = [(True, rows, depth, -1, parent)]
    while stack:
        new, members, at, owner, parent_id = stack.pop()
        if new:  # one node: members share `at` turns
            owner = node(members, at, owner, parent_id)
            ended = [m for m in members if len(m[0]) == at]
            if ended:
                nodes[owner][7] = ended[0][4]
                members = [m for m in members if len(m[0]) > at]
            while len(members) == 1 and at < len(members[0][0]):  # nothing is left to sort
                at += 1
                owner = node(members, at, owner, nodes[owner][0])
                if at == len(members[0][0]):
                    nodes[owner][7] = members[0][4]
                    members = []
        if not members:
            continue
        pivot = members[len(members) // 2][0][at]
        less, same, more = [], [], []
        for m in members:
            (same if m[0][at] == pivot else less if m[0][at] < pivot else more).append(m)
        for part in (less, more):
            if part:
                stack.append((False, part, at, owner, None))
        stack.append((True, same, at + 1, owner, nodes[owner][0]))
    for i in range(len(nodes) - 1, -1, -1):
        nodes[i][5] = nodes[i][5] or 1
        if above[i] >= 0:
            nodes[above[i]][5] += nodes[i][5]
            nodes[above[i]][6] += nodes[i][6]
    return nodes


_LOCAL = "bucket long, digit long, depth long, parent long, ids array<long>, lens array<int>, n long, least long, ends string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of local buckets, whose rows come together; the top of each carries its bucket's number as `above`."""
    names = [*(x.split()[0] for x in _NODE.split(", ")), "above"]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.int64()]

    def table(nodes: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*nodes, strict=True), kinds, strict=True)], names=names)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    held: list[list] = []
    for (bucket, _, depth, parent), members in groupby(rows(), key=lambda r: r[:4]):
        nodes = multikey([m[4:] for m in members], depth, parent)
        held += [[*x, None] for x in nodes]
        held[-len(nodes)][-1] = bucket
        for i in range(0, len(held) if len(held) >= 4096 else 0, 4096):
            yield table(held[i : i + 4096])
        held = [] if len(held) >= 4096 else held
    if held:
        yield table(held)


def _shared(ids: Column, other: Column, depth: Column) -> Column:
    """How many first elements two arrays have in common, `depth` of which are known to be."""
    differ = F.array_position(F.zip_with(F.slice(ids, depth + 1, F.size(ids)), F.slice(other, depth + 1, F.size(other)), lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differ == 0, F.size(ids)).otherwise(depth + differ.cast("int") - 1)


def _beside(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row for each distinct prefix of the conversations (conv_id, seq), as _NODE says."""
    rows = materialize(conversations.select("conv_id", F.transform("seq", lambda x: x["id"]).alias("ids"), F.transform("seq", lambda x: x["len"]).alias("lens"), F.unhex(F.sha2(F.array_join(F.transform("seq", lambda x: x["id"].cast("string")), ","), 256)).alias("key")), "sequences")
    distinct = rows.groupBy("key").agg(F.first("ids").alias("ids"), F.first("lens").alias("lens"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    distinct = materialize(distinct.join(ends(rows), "key").drop("key"), "distinct")
    total = distinct.count()
    start = distinct.withColumns({"bucket": F.lit(-1).cast("long"), "digit": F.lit(-1).cast("long"), "depth": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")})
    columns = [x.split()[0] for x in _LOCAL.split(", ")]
    locals_, rounds = [start.where(F.lit(total <= local)).select(*columns)], []
    if total > local:
        top = distinct.agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min_by("ids", "least").alias("rep"), F.min_by("lens", "least").alias("rep_lens"))
        large = top.withColumns({"id": F.lit(0).cast("long"), "top": F.lit(0), "above": F.lit(-1).cast("long"), "parent": F.lit(None).cast("long")})
        opened, numbered = distinct.withColumn("bucket", F.lit(0).cast("long")), 1
        while True:
            large = materialize(large, "large")
            # What a whole bucket shares is passed over at once.
            held = _beside(opened, large.select(F.col("id").alias("bucket"), "rep", "top", F.col("conv_id").alias("parent")), ["bucket"])
            shared = held.groupBy("bucket").agg(F.min(_shared(F.col("ids"), F.col("rep"), F.col("top"))).alias("at"))
            at = materialize(shared, "shared")
            digits = materialize(_beside(held.drop("rep", "top"), at, ["bucket"]).withColumn("digit", F.get("ids", F.col("at"))), "digits")
            groups = digits.groupBy("bucket", "digit").agg(F.count("*").alias("rows"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min_by("ids", "least").alias("rep"), F.min_by("lens", "least").alias("rep_lens"), F.max("ends").alias("ends"), F.first("at").alias("at"), F.first("parent").alias("parent"))
            groups = materialize(groups.withColumn("id", F.monotonically_increasing_id() + F.lit(numbered) * (1 << 50)), "groups")
            rounds.append((large, at, groups))
            big = groups.where(F.col("digit").isNotNull() & (F.col("rows") > local))
            rest = digits.where("digit is not null")
            if big.isEmpty():
                locals_.append(rest.withColumn("depth", F.col("at").cast("long") + 1).select(*columns))
                break
            marked = materialize(_beside(rest, big.select("bucket", "digit", F.col("id").alias("child")), ["bucket", "digit"], "left"), "marked")
            locals_.append(marked.where("child is null").withColumn("depth", F.col("at").cast("long") + 1).select(*columns))
            opened = marked.where("child is not null").select("ids", "lens", "n", "least", "ends", F.col("child").alias("bucket"))
            large = big.select("n_convs", "conv_id", "rep", "rep_lens", "id", (F.col("at") + 1).alias("top"), F.col("bucket").alias("above"), "parent")
            numbered += 1
    every = locals_[0]
    for more in locals_[1:]:
        every = every.unionByName(more)
    nodes = materialize(every.repartition("bucket", "digit").sortWithinPartitions("bucket", "digit").mapInArrow(_finish, f"{_NODE}, above long"), "nodes")
    out = nodes.drop("above")
    below = nodes.where("above >= 0").groupBy(F.col("above").alias("id")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    for large, at, groups in reversed(rounds):
        here = groups.groupBy(F.col("bucket").alias("id")).agg(F.count("digit").alias("children"), F.max(F.when(F.col("digit").isNull(), F.col("ends"))).alias("ends"))
        sums = materialize(large.join(at.withColumnRenamed("bucket", "id"), "id").join(here, "id").join(below, "id").select("id", "above", "conv_id", "parent", "n_convs", "rep_lens", "top", "at", "children", "ends", "leaves", "saved"), "sums")
        out = out.unionByName(_chains(sums))
        own = F.aggregate(F.slice("rep_lens", F.greatest(F.col("top"), F.lit(1)), F.col("at") - F.greatest(F.col("top"), F.lit(1)) + 1), F.lit(0).cast("long"), lambda a, x: a + x)
        total_here = sums.where("above >= 0").select(F.col("above").alias("id"), "leaves", (F.col("saved") + (F.col("n_convs") - 1) * own).alias("saved"))
        below = below.unionByName(total_here).groupBy("id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return out


def _chains(sums: DataFrame) -> DataFrame:
    """The nodes of large buckets: from the turn that told them from others to the one where they branch."""
    lens, depth = F.col("rep_lens"), F.col("depth")
    last = depth == F.col("at")
    rows = sums.select("*", F.explode(F.sequence("top", "at")).alias("depth"))
    onward = F.when(F.col("at") > depth, F.aggregate(F.slice(lens, depth + 1, F.col("at") - depth), F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0)
    own = F.coalesce(F.when(depth > 0, F.get(lens, depth - 1)), F.lit(0)) + onward
    return rows.select(
        "conv_id", depth.cast("long").alias("depth"), F.when(depth == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * own).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(_NONE)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return trie(rebuild(encode_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}

ORACLE_SQL = {
    "op13_prefix_trie": f"""
WITH crc AS ({CRC_TABLE_SQL}),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(row(role, text) ORDER BY turn NULLS FIRST, role, sha256(concat(strlen(role), ':', role, text))) AS seq FROM t GROUP BY conv_id),
h AS (SELECT conv_id, seq, ({crc32_sql("conv_id::VARCHAR")} % {HEADS})::BIGINT AS h FROM o, crc),
r AS (SELECT h.conv_id, coalesce(f.seq[1:h.h], []) || h.seq[h.h + 1:] AS seq FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % {FAMILY}),
p AS (SELECT conv_id, seq[1:d] AS prefix, d, d = len(seq) AS final FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE final), '')) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length((prefix[d])[2]) END AS own
  FROM p GROUP BY prefix, d
),
k AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
s AS (
  SELECT prefix[1:a] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved
  FROM (SELECT prefix, n_children, own, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1
)
SELECT m.conv_id, m.d::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s USING (prefix) LEFT JOIN n up ON m.d > 0 AND up.d = m.d - 1 AND up.prefix = m.prefix[1:m.d - 1]
"""
}

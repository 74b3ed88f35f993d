"""Merkle manifest of a documents table: one tree for each language, and one over the languages' subroots.

Trees grow by levels, each a written table: nodes have a row number within their tree, the number floor-divided by the
fanout names the parent, and a parent is the hash of its children's digests in order. Proofs come down again by a join
a level: a node's siblings are put before its parent's path, so whole paths meet documents only in the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import placed
from .common import written

FANOUT = 8
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<before:string,after:string>>"


def _hash(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(**changed: Column) -> Column:
    """Digest of a document's FIELDS (columns of that name, or those given): '-' if null, else UTF-8 bytes, ':', value."""
    values = [changed.get(name, F.col(name)).cast(kind).cast("string") for name, kind in FIELDS.items()]
    return _hash(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, start, lambda acc, s: _hash(F.concat(s["before"], acc, s["after"])))


def _grown(nodes: DataFrame, most: int, fanout: int, name: str) -> list[DataFrame]:
    """(tree, idx, width, digest and whatever the first level carries) -> a table a level: tree, up, width, kids, digest.

    width: nodes of the tree on that level; a tree that has one node left passes it up as it is. most: the greatest width.
    """
    levels: list[DataFrame] = []
    while most > 1 or not levels:
        kid = F.struct("idx", *[c for c in nodes.columns if c not in ("tree", "idx", "width")])
        up = nodes.groupBy("tree", F.floor(F.col("idx") / fanout).alias("up")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.max("width").alias("width"))
        joined = F.concat_ws("", F.transform("kids", lambda k: k["digest"]))
        up = up.withColumn("digest", F.when(F.col("width") > 1, _hash(joined)).otherwise(F.col("kids")[0]["digest"]))
        levels.append(written(up, f"merkle-{name}-{len(levels)}"))
        nodes = levels[-1].select("tree", F.col("up").alias("idx"), F.ceil(F.col("width") / fanout).alias("width"), "digest")
        most = -(-most // fanout)
    return levels


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """above: tree, idx, path and more of the nodes over the last level -> tree, kid, path and more of the first level's kids."""
    more = [c for c in above.columns if c not in ("tree", "idx", "path")]
    for table in reversed(levels):
        rows = table.drop("digest").join(above.withColumnRenamed("idx", "up"), ["tree", "up"])
        rows = rows.select("tree", "path", "width", "kids", *more, F.posexplode("kids").alias("at", "kid"))
        beside = [F.concat_ws("", F.transform(s, lambda k: k["digest"])) for s in (F.slice("kids", 1, F.col("at")), F.slice("kids", F.col("at") + 2, F.size("kids")))]
        step = F.array(F.struct(beside[0].alias("before"), beside[1].alias("after")))
        path = F.when(F.col("width") > 1, F.concat(step, "path")).otherwise(F.col("path"))
        rows = rows.select("tree", path.alias("path"), "kid", *more)
        above = rows.select("tree", F.col("kid.idx").alias("idx"), "path", *more)
    return rows


def manifest(docs: DataFrame, fanout: int = FANOUT, **carried: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (from the leaf up: the siblings before and after), and the carried columns.

    A row for each row of docs. Within a language leaves stand by doc_id (null first), then by digest; null is a
    language of its own, before all others, and differs from an empty one. Null fields and empty or long texts are
    hashed as leaf() says. Equal rows are leaves of their own. A language of one document has its leaf as subroot, and
    of one language the subroot is the root. An empty table gives an empty one. Other columns play no part, and their
    names cannot clash. carried: columns of docs that are worked out beside the leaf.
    """
    spark = docs.sparkSession
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))  # null first, others bytewise
    own = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), *[c.alias(k) for k, c in carried.items()], F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    leaves = written(own, "merkle-leaves")  # texts are read once; deal spreads equal rows over ranges
    widths = leaves.groupBy("tree").agg(F.count("*").alias("width"))
    most, trees = widths.agg(F.max("width"), F.count("*")).first()
    if not trees:
        kinds = leaves.select("doc_id", F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(STEP).alias("proof"), *carried)
        return spark.createDataFrame([], kinds.schema)
    order = [F.asc("doc_id"), F.asc("digest"), F.asc("deal")]
    nodes = placed(leaves, ["tree"], order, "n").withColumn("idx", F.col("n") - 1).drop("n", "deal").join(widths, "tree")
    levels = _grown(nodes, most, fanout, "level")
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = placed(subroots, ["tree"], [F.asc("name")], "n").select("tree", (F.col("n") - 1).alias("idx"), F.lit(trees).alias("width"), "digest", "name")
    over = _grown(tops, trees, fanout, "top")
    root = over[-1].select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("idx"), F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    heads = _paths(over, root).select(F.col("kid.name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("kid.digest").alias("subroot"), "root")
    found = _paths(levels, heads)
    return found.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.digest").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), *[F.col(f"kid.{k}").alias(k) for k in carried])


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a third of the texts is tampered with, and found out.

    Where 3 divides the unsigned crc32 of the decimal doc_id (null: not), the text's A-Z are lower-cased before the
    leaf is worked out again; null texts stay, and texts without A-Z still verify.
    """
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    forged = F.when(tampered, leaf(text=F.translate(F.col("text").cast("string"), UPPER, LOWER)))
    rows = manifest(docs, forged=forged)
    proof = _hash(F.concat_ws("", F.transform("proof", lambda s: F.concat(s["before"], s["after"]))))
    rows = rows.withColumn("proof_sha256", proof).withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql() -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
    hashed = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    levels = """
{0}(level, tree, idx, width, h) AS (
    SELECT 0, tree, idx, width, h FROM {1}
    UNION ALL
    SELECT any_value(level) + 1, tree, idx // 8, (any_value(width) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
    FROM {0} WHERE width > 1 GROUP BY tree, idx // 8
), {0}_beside AS (
    SELECT level, tree, idx, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM {0} WHERE width > 1 WINDOW run AS (PARTITION BY level, tree, idx // 8 ORDER BY idx)
)"""
    folds = """
{0}_fold(row, level, tree, idx, width, acc, proof) AS (
    SELECT row, 0, tree, idx, width, acc, proof FROM {1}
    UNION ALL
    SELECT row, level + 1, tree, idx // 8, (width + 7) // 8, sha256(before || acc || after), proof || before || after
    FROM {0}_fold JOIN {0}_beside USING (level, tree, idx)
)"""
    return f"""
WITH RECURSIVE bits AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), summed AS (
    SELECT d.*, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
    FROM documents d, bits
), leaves AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce('1' || lang, '0') AS tree, {hashed("text")} AS h,
           CASE WHEN crc % 3 = 0 THEN {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {hashed("text")} END AS forged
    FROM summed
), nodes AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS width FROM leaves
), {levels.format("low", "nodes")}, tops AS (
    SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS width, h FROM low WHERE width = 1
), {levels.format("high", "tops")}, started AS (
    SELECT row, tree, idx, width, forged AS acc, '' AS proof FROM nodes
), {folds.format("low", "started")}, between AS (
    SELECT f.row, t.tree, t.idx, t.width, f.acc, f.proof FROM low_fold f JOIN tops t ON f.tree = t.name WHERE f.width = 1
), {folds.format("high", "between")}
SELECT doc_id, n.h AS leaf, t.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = r.h AS verified
FROM nodes n JOIN tops t ON n.tree = t.name JOIN high_fold f ON f.row = n.row AND f.width = 1 JOIN high r ON r.width = 1
"""

"""A Merkle manifest of a dataset, with proofs by the preimages of each leaf's ancestors.

Every row is a leaf, the hash of its fields. Per group (a source) the leaves stand in order, and every FAN consecutive
nodes become one, whose preimage is the text of its children's hashes one after the other; what remains is the group's
subroot. Subroots, in order of their groups, become the root in the same way. What is stored for a parent is its
preimage. A leaf's path is the list of its ancestors' preimages, each with the slot (of HEX characters) that the path
comes through. With the slot cut out a preimage is the siblings, so the path proves the leaf; with another hash put in
the slot it is the parent's preimage under that hash, so a changed leaf folds to the root it would give.

A group may hold most of the rows. Leaves are numbered over ranges, and a tree grows in blocks of FAN ** DEPTH nodes:
a block climbs DEPTH levels within one row, so a group of n leaves takes log n / log 81 rounds, each 81 times smaller.
Paths come down the same blocks. Everything is Spark's own functions, and the texts are read once, to be hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, levels that a block climbs, characters of a hash.
FAN, DEPTH, HEX = 3, 4, 64
WIDTH = FAN**DEPTH


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    sized = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*sized), 256)


def siblings(path: Column) -> Column:
    """The hashes beside a path, level by level, left to right, as one text."""
    return F.concat_ws("", F.transform(path, lambda p: F.overlay(p.preimage, F.lit(""), p.slot * HEX + 1, F.lit(HEX))))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.overlay(p.preimage, h, p.slot * HEX + 1, F.lit(HEX)), 256))


@dataclass
class Manifest:
    """proofs: a row for each leaf with its carried columns, ``leaf``, ``path``, ``subroot`` and ``root``; blocks: the rounds of the groups' trees and of the root's."""

    proofs: DataFrame
    blocks: list[DataFrame]
    top_blocks: list[DataFrame]

    def nodes(self) -> DataFrame:
        """The stored tree: grp (``0`` for null, else ``1`` and the group; empty in the root's tree), level (from 1), position, preimage, hash."""
        found = None
        for rounds in (self.blocks, self.top_blocks):
            for k, blocks in enumerate(rounds):
                for level in range(1, DEPTH + 1):
                    rows = blocks.select("grp", F.lit(k * DEPTH + level).alias("level"), F.col("block") * FAN ** (DEPTH - level), F.posexplode(f"level{level}"))
                    rows = rows.toDF("grp", "level", "first", "i", "preimage").select("grp", "level", (F.col("first") + F.col("i")).alias("position"), "preimage", F.sha2("preimage", 256).alias("hash"))
                    found = rows if found is None else found.unionByName(rows)
        return found


def _climb(nodes: DataFrame, rounds: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round over nodes (grp, position, total, hash, row), and the one node left of each group."""
    out = []
    for k in range(rounds):
        block = F.floor(F.col("position") / WIDTH).cast("long").alias("block")
        child = F.struct("position", "hash", "row")
        blocks = nodes.groupBy("grp", block).agg(F.min("total").alias("total"), F.sort_array(F.collect_list(child)).alias("children"))
        hashes = F.col("children.hash")
        for level in range(1, DEPTH + 1):
            blocks = blocks.withColumn("below", hashes)
            # a group whose one node is left has no more parents
            many = F.col("total") > FAN ** (level - 1)
            runs = F.sequence(F.lit(0), F.floor((F.size("below") - 1) / FAN).cast("int"))
            preimages = F.transform(runs, lambda i: F.concat_ws("", F.slice("below", i * FAN + 1, FAN)))
            blocks = blocks.withColumn(f"level{level}", F.when(many, preimages).otherwise(F.array().cast("array<string>")))
            hashes = F.when(many, F.transform(f"level{level}", lambda x: F.sha2(x, 256))).otherwise(F.col("below"))
        blocks = materialize(blocks.withColumn("hash", F.element_at(hashes, 1)).drop("below"), f"{name}-{k}")
        out.append(blocks)
        nodes = blocks.select("grp", F.col("block").alias("position"), F.ceil(F.col("total") / WIDTH).alias("total"), "hash", F.lit(None).alias("row"))
    return out, nodes.select("grp", "hash")


def _descend(blocks: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first round's children (position, hash, row) with path, root and subroot, from each group's (grp, path, root, subroot)."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for k, rows in reversed(list(enumerate(blocks))):
        within = F.expr(f"pmod(child.position, {WIDTH})")
        steps = [
            F.struct(F.get(f"level{level}", F.floor(within / FAN**level)).alias("preimage"), F.floor(within / FAN ** (level - 1) % FAN).cast("int").alias("slot"))
            for level in range(1, DEPTH + 1)
        ]
        own = F.filter(F.array(*steps), lambda p: p.preimage.isNotNull())
        rows = rows.drop("hash").join(above, ["grp", "block"]).withColumn("child", F.explode("children"))
        rows = rows.select("grp", "child.*", F.concat(own, F.col("path")).alias("path"), "root", "subroot")
        above = rows.withColumnRenamed("position", "block").drop("hash", "row") if k else rows
    return above


def _rounds(most: int) -> int:
    """Rounds that leave one node of ``most``."""
    n = 0
    while most > 1:
        most, n = -(-most // WIDTH), n + 1
    return max(1, n)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry`` names columns (by expressions over ``docs``) that come along to ``proofs``.

    Nulls are values of their own: in a field ``-``, as a group the first, as an order before all others. Rows of one
    group and order stand by their leaf hashes, and repeated rows are leaves each. A group of one row has its leaf as
    its subroot, a dataset of one group that subroot as its root; an empty path proves it. No rows give no proofs.
    Other columns of ``docs``, whatever their names, have no part.
    """
    carry = carry or {}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("grp"), F.col(order).alias("ord"),
        leaf_hash(*[F.col(f) for f in fields]).alias("hash"), F.struct(F.lit(True).alias("leaf"), *[c.alias(n) for n, c in carry.items()]).alias("row"),
    )
    leaves = materialize(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    placed = numbered(leaves, "grp", [F.asc_nulls_first("ord"), F.col("hash"), F.col("tie")], "placed").drop("ord", "tie")
    most = placed.agg(F.max("total")).first()[0] or 0
    blocks, subroots = _climb(placed, _rounds(most), "tree")
    # the same over the subroots, as one group in order of their names
    sources = subroots.select(F.lit("").alias("all"), "hash", F.struct("grp").alias("row"), F.col("grp").alias("ord"))
    sources = numbered(sources, "all", [F.col("ord")], "sources").withColumnRenamed("all", "grp").drop("ord")
    top_blocks, root = _climb(sources, _rounds(sources.count()), "top")
    none = F.array().cast(f"array<struct<preimage:string,slot:int>>")
    tops = _descend(top_blocks, root.select("grp", none.alias("path"), F.col("hash").alias("root"), F.lit(None).cast("string").alias("subroot")))
    tops = materialize(tops.select(F.col("row.grp").alias("grp"), "path", "root", F.col("hash").alias("subroot")), "subroots")
    proofs = _descend(blocks, tops).select(*[F.col(f"row.{n}").alias(n) for n in carry], F.col("hash").alias("leaf"), "path", "subroot", "root")
    return Manifest(proofs, blocks, top_blocks)


def tamper_audit(docs: DataFrame) -> DataFrame:
    """Every row's proof checked against a tampered copy: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Tampering deletes the line feeds of texts whose doc_id's CRC-32 (of its decimal digits) is even; null texts and rows
    without a doc_id stay as they are, and so does what has no line feed, which then verifies.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    altered = leaf_hash(*[F.col(f) if f != "text" else text for f in FIELDS])
    found = manifest(docs, carry={"doc_id": F.col("doc_id"), "altered": altered}).proofs
    found = found.withColumn("folded_root", fold(F.col("altered"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: A table of CRC-32 remainders by recursion, and the CRC of a text over its hexadecimal bytes.
CRC_TABLE = """crc_bits AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB's expression of the unsigned CRC-32 of a non-empty text; needs CRC_TABLE and its one row ``crc_table``."""
    data = f"list_transform(range(1, 1 + strlen({text})), lambda i: ('0x' || hex(encode({text}))[2 * i - 1:2 * i])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT)"


def _sized(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(_sized(c) for c in FIELDS[:-1])
_TREE = "SELECT {l} + 1, grp, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY {l}, grp, pos // 3, n"
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS grp, sha256({_HEAD} || {_sized('text')}) AS leaf,
    CASE WHEN {crc_sql('doc_id::VARCHAR')} % 2 = 0 THEN sha256({_HEAD} || {_sized("replace(text, chr(10), '')")}) END AS altered
  FROM documents, crc_table
), placed AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), tree(lvl, grp, pos, n, h) AS (
  SELECT 0, grp, pos, n, leaf FROM placed UNION ALL {_TREE.format(l='lvl', t='tree')}
), subs AS (SELECT grp AS source, '' AS grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top(lvl, grp, pos, n, h) AS (
  SELECT 1000, grp, pos, n, h FROM subs UNION ALL {_TREE.format(l='lvl', t='top')}
), steps AS (
  SELECT id, lvl, p.pos // (3 ** lvl)::BIGINT AS place, list(struct_pack(pos := t.pos, h := t.h) ORDER BY t.pos) AS run
  FROM placed p JOIN tree t ON t.grp = p.grp AND t.n > 1 AND t.pos // 3 = p.pos // (3 ** (lvl + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT id, lvl, s.pos // (3 ** (lvl - 1000))::BIGINT, list(struct_pack(pos := t.pos, h := t.h) ORDER BY t.pos)
  FROM placed p JOIN subs s ON s.source = p.grp JOIN top t ON t.n > 1 AND t.pos // 3 = s.pos // (3 ** (lvl - 999))::BIGINT GROUP BY ALL
), sides AS (
  SELECT id, lvl, array_to_string(list_transform(list_filter(run, lambda x: x.pos < place), lambda x: x.h), '') AS l, array_to_string(list_transform(list_filter(run, lambda x: x.pos > place), lambda x: x.h), '') AS r FROM steps
), paths AS (SELECT id, string_agg(l || r, '' ORDER BY lvl) AS beside, list(struct_pack(l := l, h := '', r := r) ORDER BY lvl) AS path FROM sides GROUP BY id),
found AS (
  SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(beside, '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(l := '', h := coalesce(altered, leaf), r := ''), coalesce(path, [])), lambda a, x: struct_pack(l := '', h := sha256(x.l || a.h || x.r), r := '')).h AS folded_root
  FROM placed p JOIN subs s ON s.source = p.grp LEFT JOIN paths USING (id)
)
SELECT *, folded_root = root AS verified FROM found
"""

"""All queries and their oracle SQL by name.

Each query reads the driver tables, runs one operator over all of their rows, and has
columns named as in its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import numbers as N
from ..functions.crc import TABLE as CRC_TABLE
from ..functions.crc import crc32c_col
from ..model import files_from, last_seq, ops, placed, table, user_key
from ..operators import compaction as C
from ..operators import histogram as H
from ..operators import ranges as R
from ..operators import versions as V
from ..operators import visible as S

QUERIES: dict = {}
ORACLES: dict = {}

BASE = """
WITH ops AS (SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind,
  printf('user%08d', user_id) AS key, CASE WHEN event_type <> 'error' THEN props END AS value FROM events),
n AS (SELECT max(seq) AS m FROM ops),
vis AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS rn
  FROM ops) WHERE rn = 1 AND kind = 1),
placed AS (SELECT ops.*, CAST(substr(key, 5) AS BIGINT) AS uid, (seq * 10) // (m + 1) AS age FROM ops, n),
seg AS (SELECT *, CAST(CASE WHEN age >= 7 THEN 0 WHEN age >= 4 THEN 1 ELSE 2 END AS BIGINT) AS level,
  CAST(CASE WHEN age >= 7 THEN 201 + age WHEN age >= 4 THEN 101 + uid // 50 ELSE 1 + uid // 25 END AS BIGINT) AS file_no FROM placed),
files AS (SELECT level, file_no, count(*) AS num_entries, min(key) AS lo, max(key) AS hi, max(seq) AS max_seq,
  CAST(sum(length(key) + 8 + coalesce(length(value), 0)) AS BIGINT) AS file_size FROM seg GROUP BY level, file_no)
"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a query; ``sql`` follows the base WITH unless it has its own."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql if sql.lstrip().startswith("WITH") else BASE + sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def state(spark, d) -> DataFrame:
    return S.visible_state(ops(spark, d))


def segments(spark, d) -> DataFrame:
    log = ops(spark, d)
    return placed(log, last_seq(log))


def files(spark, d) -> DataFrame:
    return files_from(segments(spark, d))


def customer_keys(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(user_key(F.col("c_custkey")).alias("key"))


def binary(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("binary") for n in names})


# Reads


@query("SELECT key, value FROM vis")
def visible_state(spark, d):
    return state(spark, d)


@query("""SELECT key, value FROM (SELECT ops.*, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS rn
  FROM ops, n WHERE seq <= m // 2) WHERE rn = 1 AND kind = 1""")
def visible_state_at_half(spark, d):
    log = ops(spark, d)
    return S.visible_state(log, last_seq(log) // 2)


@query("SELECT key, value FROM vis ORDER BY key")
def scan_forward(spark, d):
    return S.scan(ops(spark, d))


@query("SELECT key, value FROM vis ORDER BY key DESC")
def scan_reverse(spark, d):
    return S.scan(ops(spark, d), reverse=True)


@query("SELECT key, value FROM vis ORDER BY key LIMIT 20")
def scan_limit(spark, d):
    return S.scan(ops(spark, d), limit=20)


@query("SELECT key, value FROM vis ORDER BY key DESC LIMIT 20")
def scan_reverse_limit(spark, d):
    return S.scan(ops(spark, d), reverse=True, limit=20)


@query("SELECT key, value FROM vis WHERE key = (SELECT min(key) FROM vis)")
def get(spark, d):
    log = ops(spark, d)
    return S.get(log, S.scan(log, limit=1).first()["key"])


@query("SELECT key, value FROM vis WHERE key >= 'user00000007x' ORDER BY key LIMIT 1")
def seek(spark, d):
    return S.seek(ops(spark, d), "user00000007x")


@query("""SELECT 'next' AS move, min(key) AS key FROM vis WHERE key > 'user00000007'
  UNION ALL SELECT 'prev', max(key) FROM vis WHERE key < 'user00000007'""")
def direction_switch(spark, d):
    log = ops(spark, d)
    up, down = (S.step(log, "user00000007", f).select(F.lit(n).alias("move"), "key") for f, n in ((True, "next"), (False, "prev")))
    return up.unionByName(down)


@query("SELECT key, value FROM vis WHERE key >= 'user00000005' AND key < 'user00000012'")
def range_scan(spark, d):
    return S.scan(ops(spark, d), start="user00000005", limit_key="user00000012")


@query("SELECT key, value FROM vis WHERE starts_with(key, 'user0000000')")
def prefix_scan(spark, d):
    return S.prefix_scan(ops(spark, d), "user0000000")


@query("""SELECT l.key, v.value, v.key IS NOT NULL AS found
  FROM (SELECT DISTINCT printf('user%08d', c_custkey) AS key FROM customer) l LEFT JOIN vis v ON l.key = v.key""")
def multi_get(spark, d):
    return S.multi_get(ops(spark, d), customer_keys(spark, d))


@query("""SELECT l.key FROM (SELECT DISTINCT printf('user%08d', c_custkey) AS key FROM customer) l
  WHERE NOT EXISTS (SELECT 1 FROM vis v WHERE v.key = l.key)""")
def get_missing(spark, d):
    return S.missing(ops(spark, d), customer_keys(spark, d))


@query("""SELECT l.key, count(*) AS lookups, any_value(v.value) AS value FROM (SELECT printf('user%08d', o_custkey % 10) AS key FROM orders) l
  LEFT JOIN vis v ON l.key = v.key GROUP BY l.key""")
def get_hot(spark, d):
    """Lookups crowded on ten keys: they are counted before the join."""
    asked = table(spark, d, "orders").select(user_key(F.col("o_custkey") % 10).alias("key")).groupBy("key").agg(F.count("*").alias("lookups"))
    return asked.join(S.multi_get(ops(spark, d), asked), "key").select("key", "lookups", "value")


@query("""SELECT t.key AS target, min(v.key) AS found FROM (SELECT DISTINCT printf('user%08d', s_suppkey * 3) AS key FROM supplier) t
  LEFT JOIN vis v ON v.key >= t.key GROUP BY t.key""")
def multi_seek(spark, d):
    return S.multi_seek(ops(spark, d), table(spark, d, "supplier").select(user_key(F.col("s_suppkey") * 3).alias("target")))


@query("SELECT key, seq, kind, value FROM ops")
def internal_scan(spark, d):
    rows = segments(spark, d)
    return S.internal_scan(*(rows.where(F.col("level") == n) for n in range(3)))


@query("SELECT key, seq, kind, value FROM ops ORDER BY key, seq DESC, kind DESC")
def merge_sorted(spark, d):
    rows = segments(spark, d)
    return S.merge_sorted(*(rows.where(F.col("level") == n) for n in range(3)))


@query("""SELECT f.level, f.file_no, s.key, s.seq FROM files f JOIN seg s ON s.level = f.level AND s.file_no = f.file_no
  WHERE f.level >= 1 ORDER BY 1, 2, 3, 4 DESC""")
def two_level_scan(spark, d):
    """Index entries in order, and for each the entries of its block."""
    index = files(spark, d).where("level >= 1").select("level", "file_no")
    return index.join(segments(spark, d).select("level", "file_no", "key", "seq"), ["level", "file_no"]).orderBy("level", "file_no", "key", F.desc("seq"))


@query("SELECT key, seq FROM ops o WHERE seq < (SELECT max(seq) FROM ops p WHERE p.key = o.key)")
def hidden_versions(spark, d):
    return S.hidden_versions(ops(spark, d))


@query("SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS rn FROM ops")
def version_rank(spark, d):
    return S.version_rank(ops(spark, d))


# Compaction


@query("""SELECT key, seq, kind FROM (SELECT ops.*, m * 6 // 10 AS ss,
  lag(seq) OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS prev FROM ops, n)
  WHERE NOT coalesce(prev <= ss, false) AND NOT (kind = 0 AND seq <= ss)""")
def compact_retain(spark, d):
    log = ops(spark, d)
    return C.retain(log, last_seq(log) * 6 // 10).select("key", "seq", "kind")


@query("""SELECT key, seq, kind FROM (SELECT ops.*, m * 6 // 10 AS ss,
  lag(seq) OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS prev FROM ops, n) o
  WHERE NOT coalesce(prev <= ss, false) AND NOT (kind = 0 AND seq <= ss AND NOT EXISTS
  (SELECT 1 FROM files f WHERE f.level = 2 AND o.key BETWEEN f.lo AND f.hi))""")
def compact_retain_over_base(spark, d):
    log = ops(spark, d)
    deeper = files(spark, d).where("level = 2")
    return C.retain(log, last_seq(log) * 6 // 10, deeper).select("key", "seq", "kind")


@query("""SELECT DISTINCT s.key FROM (SELECT key FROM seg WHERE level = 0 UNION SELECT printf('user%08d', c_custkey) FROM customer) s
  WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.level >= 2 AND s.key BETWEEN f.lo AND f.hi)""")
def base_level_keys(spark, d):
    """Of the keys of level 0 and of all customers, those that no deeper file can hold."""
    keys = segments(spark, d).where("level = 0").select("key").unionByName(customer_keys(spark, d))
    return V.base_level_keys(keys, files(spark, d).where("level >= 2"))


@query("""SELECT key, seq, coalesce(kind, 2) AS kind FROM (SELECT ops.*, m * 6 // 10 AS ss,
  lag(seq) OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS prev FROM ops, n WHERE seq % 50 <> 0)
  WHERE NOT coalesce(prev <= ss, false) AND NOT (kind = 0 AND seq <= ss) UNION ALL SELECT key, seq, 2 FROM ops WHERE seq % 50 = 0""")
def compact_keeps_damage(spark, d):
    """Every fiftieth internal key has a kind that is not known; these stay as they are."""
    kind = F.when(F.col("seq") % 50 == 0, 2).otherwise(F.col("kind"))
    log = ops(spark, d)
    raw = log.select(K.internal_key(F.col("key").cast("binary"), F.col("seq"), kind).alias("internal"), "value")
    n = F.length("internal")
    out = C.retain_raw(raw, last_seq(log) * 6 // 10).select(F.substring("internal", F.lit(1), n - 8).cast("string").alias("key"), K.fixed_value(F.concat(F.substring("internal", n - 6, F.lit(7)), F.lit(bytearray(1))), F.lit(0), 8).alias("seq"), K.byte_at(F.col("internal"), n - 8).alias("kind"))
    return out


@query("""SELECT level, CAST(CASE WHEN level = 0 THEN count(*) / 4.0
  ELSE CAST(sum(file_size) AS DOUBLE) / (10485760.0 * pow(10, level - 1)) END AS DOUBLE) AS score FROM files GROUP BY level""")
def compaction_score(spark, d):
    return C.score(files(spark, d))


@query("""SELECT level, score FROM (SELECT level, CAST(CASE WHEN level = 0 THEN count(*) / 4.0
  ELSE CAST(sum(file_size) AS DOUBLE) / (10485760.0 * pow(10, level - 1)) END AS DOUBLE) AS score FROM files GROUP BY level)
  ORDER BY score DESC, level LIMIT 1""")
def level_to_compact(spark, d):
    return C.level_to_compact(files(spark, d))


@query("""SELECT level, coalesce(min_by(file_no, hi) FILTER (hi > 'user00000060'), min_by(file_no, lo)) AS file_no
  FROM files WHERE level >= 1 GROUP BY level""")
def pick_compaction(spark, d):
    return C.pick_files(files(spark, d), "user00000060")


@query("SELECT file_no, CAST(greatest(100, file_size // 16384) AS BIGINT) AS allowed_seeks FROM files")
def allowed_seeks(spark, d):
    return C.allowed_seeks(files(spark, d))


@query("""SELECT a.level, a.file_no FROM files a WHERE NOT EXISTS
  (SELECT 1 FROM files b WHERE b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi)""")
def trivial_moves(spark, d):
    return V.trivial_moves(files(spark, d))


@query(f"""WITH RECURSIVE {BASE.strip().removeprefix('WITH ')}, e AS (SELECT file_no, key, seq, length(key) + 8 + coalesce(length(value), 0) AS bytes,
   row_number() OVER (PARTITION BY file_no ORDER BY key, seq DESC) AS rn FROM seg),
 walk AS (SELECT file_no, key, seq, rn, 0 AS block, bytes AS total FROM e WHERE rn = 1
  UNION ALL SELECT e.file_no, e.key, e.seq, e.rn, walk.block + CASE WHEN walk.total >= 4096 THEN 1 ELSE 0 END, e.bytes + CASE WHEN walk.total >= 4096 THEN 0 ELSE walk.total END
  FROM walk JOIN e ON e.file_no = walk.file_no AND e.rn = walk.rn + 1)
 SELECT file_no, key, seq, CAST(block AS BIGINT) AS block FROM walk""")
def block_cut(spark, d):
    """Entries of each file with the number of the block that a 4 KiB limit puts them in."""
    rows = segments(spark, d).select("file_no", "key", "seq", (F.length("key") + 8 + F.coalesce(F.length("value"), F.lit(0))).cast("long").alias("bytes"), (-F.col("seq")).alias("newest"))
    return C.greedy_cut(rows, "file_no", ["key", "newest"], "bytes", 4096).select("file_no", "key", "seq", F.col("part").alias("block"))


@query(f"""WITH RECURSIVE {BASE.strip().removeprefix('WITH ')}, one AS (SELECT DISTINCT file_no, key FROM seg WHERE level = 1),
 passed AS (SELECT found AS key, sum(file_size) AS bytes FROM (SELECT f.file_size, (SELECT min(o.key) FROM one o WHERE o.key > f.hi) AS found FROM files f WHERE f.level = 2) GROUP BY found),
 e AS (SELECT one.file_no, one.key, coalesce(bytes, 0) AS bytes, row_number() OVER (PARTITION BY one.file_no ORDER BY one.key) AS rn FROM one LEFT JOIN passed ON passed.key = one.key),
 walk AS (SELECT file_no, key, rn, 0 AS part, CAST(0 AS HUGEINT) AS total FROM e WHERE rn = 1
  UNION ALL SELECT e.file_no, e.key, e.rn, walk.part + CASE WHEN walk.total + e.bytes > 2000 THEN 1 ELSE 0 END, CASE WHEN walk.total + e.bytes > 2000 THEN 0 ELSE walk.total + e.bytes END
  FROM walk JOIN e ON e.file_no = walk.file_no AND e.rn = walk.rn + 1)
 SELECT file_no, key, CAST(part AS BIGINT) AS part FROM walk""")
def grandparent_cut(spark, d):
    """Level 1 keys cut where more than 2000 bytes of level 2 files have been passed."""
    rows = segments(spark, d).where("level = 1").select("file_no", "key").distinct()
    return C.grandparent_cut(rows, "file_no", files(spark, d).where("level = 2"), 2000).select("file_no", "key", "part")


# Versions and files


@query("SELECT level, count(*) AS files, CAST(sum(num_entries) AS BIGINT) AS entries, CAST(sum(file_size) AS BIGINT) AS bytes FROM files GROUP BY level")
def level_summary(spark, d):
    return V.level_summary(files(spark, d))


@query("SELECT level, min(lo) AS smallest, max(hi) AS largest FROM files GROUP BY level")
def key_range(spark, d):
    return V.key_range(files(spark, d))


@query("SELECT k.key, f.level, min_by(f.file_no, f.hi) AS file_no FROM vis k JOIN files f ON f.level >= 1 AND f.hi >= k.key GROUP BY k.key, f.level")
def find_file(spark, d):
    return V.find_file(state(spark, d), files(spark, d))


@query("SELECT k.key, f.level, f.file_no FROM vis k JOIN files f ON k.key BETWEEN f.lo AND f.hi")
def files_for_key(spark, d):
    return V.files_for_key(state(spark, d), files(spark, d))


@query("SELECT DISTINCT a.file_no FROM files a JOIN files b ON b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi")
def overlap_in_level(spark, d):
    return V.overlap_in_level(files(spark, d))


@query("""SELECT a.level, a.file_no, b.file_no AS next_file_no, b.file_size FROM files a
  JOIN files b ON b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi""")
def overlapping_inputs(spark, d):
    return V.next_level_overlaps(files(spark, d))


@query("""SELECT file_no, CAST(sum(CASE WHEN lo > top THEN 1 ELSE 0 END) OVER (ORDER BY lo, file_no) AS BIGINT) AS island FROM
  (SELECT *, max(hi) OVER (ORDER BY lo, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM files WHERE level = 0)""")
def overlap_islands(spark, d):
    return V.overlap_islands(files(spark, d))


@query("""SELECT CAST(max(s) AS BIGINT) AS bytes FROM (SELECT a.file_no, sum(b.file_size) AS s FROM files a
  JOIN files b ON b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.level >= 1 GROUP BY a.file_no)""")
def max_next_level_overlap(spark, d):
    return V.max_next_level_overlap(files(spark, d))


@query("""SELECT r.id, CAST(CASE WHEN bool_or(f.level = 0) THEN 0 WHEN bool_or(f.level = 1) OR coalesce(sum(f.file_size) FILTER (f.level = 2), 0) > 20971520 THEN 0
  WHEN bool_or(f.level = 2) THEN 1 ELSE 2 END AS BIGINT) AS level
  FROM (SELECT n_nationkey AS id, printf('user%08d', n_nationkey * 500) AS lo, printf('user%08d', n_nationkey * 500 + 40) AS hi FROM nation) r
  LEFT JOIN files f ON f.lo <= r.hi AND r.lo <= f.hi GROUP BY r.id""")
def memtable_output_level(spark, d):
    base = F.col("n_nationkey") * 500
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), user_key(base).alias("lo"), user_key(base + 40).alias("hi"))
    return V.memtable_output_level(asked, files(spark, d), 20 << 20)


@query("SELECT file_no FROM files WHERE level = 0 UNION SELECT file_no FROM files WHERE level >= 1")
def live_files(spark, d):
    f = files(spark, d)
    return V.live_files(f.where("level = 0"), f.where("level >= 1"))


@query("""SELECT file_no FROM (SELECT file_no, 1 AS e, 'add' AS op FROM files
  UNION ALL SELECT file_no, 2, 'remove' FROM files WHERE level = 0
  UNION ALL SELECT file_no, 3, 'add' FROM files WHERE file_no = 209) GROUP BY file_no HAVING max_by(op, e) = 'add'""")
def version_apply(spark, d):
    f = files(spark, d)
    edit = lambda rows, n, op: rows.select("file_no", F.lit(n).alias("edit_no"), F.lit(op).alias("op"))
    return V.apply_edits(edit(f, 1, "add").unionByName(edit(f.where("level = 0"), 2, "remove")).unionByName(edit(f.where("file_no = 209"), 3, "add")))


@query("SELECT d.file_no FROM (SELECT range AS file_no FROM range(1, 215)) d WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.file_no = d.file_no)")
def obsolete_files(spark, d):
    return V.obsolete(spark.range(1, 215).withColumnRenamed("id", "file_no"), files(spark, d))


@query("SELECT file_no FROM files WHERE file_no % 7 <> 0 EXCEPT SELECT range FROM range(1, 205)")
def missing_files(spark, d):
    """Files that the version names and the directory lacks."""
    return V.obsolete(files(spark, d).where("file_no % 7 <> 0"), spark.range(1, 205).withColumnRenamed("id", "file_no"))


@query("""SELECT r.lo, r.hi, CAST(coalesce(sum(length(key) + length(value)), 0) AS BIGINT) AS bytes
  FROM (VALUES ('user00000000','user00000050'), ('user00000050','user00000100'), ('x','y')) r(lo, hi)
  LEFT JOIN vis ON key >= r.lo AND key < r.hi GROUP BY r.lo, r.hi""")
def approximate_sizes(spark, d):
    asked = spark.createDataFrame([("user00000000", "user00000050"), ("user00000050", "user00000100"), ("x", "y")], "lo string, hi string")
    return V.approximate_sizes(state(spark, d), asked)


@query("SELECT file_no, count(*) AS entries, min(key) AS smallest, max(key) AS largest, max(seq) AS max_sequence FROM seg GROUP BY file_no")
def repair_metadata(spark, d):
    return V.repair_metadata(segments(spark, d))


@query("""SELECT level, min_by(key, (key, -seq)) AS smallest, min_by(seq, (key, -seq)) AS smallest_seq, max_by(key, (key, -seq)) AS largest, max_by(seq, (key, -seq)) AS largest_seq
  FROM seg GROUP BY level""")
def internal_key_range(spark, d):
    return V.internal_range(segments(spark, d))


_PIECES = """SELECT level, file_no * 1000 + (rn - 1) // 7 AS file_no, key, seq FROM
  (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY key, seq DESC) AS rn FROM seg WHERE level >= 1)"""


@query(f"""{BASE}, pieces AS ({_PIECES}), p AS (SELECT level, file_no, min(key) AS lo, max_by(seq, (seq)) FILTER (key = a.a) AS lo_seq, max(key) AS hi, min(seq) FILTER (key = a.z) AS hi_seq
   FROM (SELECT *, min(key) OVER w AS a, max(key) OVER w AS z FROM pieces WINDOW w AS (PARTITION BY level, file_no)) a GROUP BY level, file_no)
 SELECT a.file_no, b.file_no AS next_file_no FROM p a JOIN p b ON a.level = b.level AND a.hi = b.lo AND b.lo_seq < a.hi_seq AND a.file_no <> b.file_no
 QUALIFY row_number() OVER (PARTITION BY a.level, a.file_no ORDER BY b.lo_seq DESC) = 1""")
def boundary_inputs(spark, d):
    """Files of seven entries each: versions of a user key run on in the next file."""
    from pyspark.sql import Window

    rows = segments(spark, d).where("level >= 1").withColumn("rn", F.row_number().over(Window.partitionBy("file_no").orderBy("key", F.desc("seq"))))
    ends = [f(F.struct("key", (-F.col("seq")).alias("s"))).alias(n) for f, n in ((F.min, "a"), (F.max, "z"))]
    per = rows.groupBy("level", (F.col("file_no") * 1000 + F.floor((F.col("rn") - 1) / 7)).alias("file_no")).agg(*ends)
    return V.boundary_inputs(per.select("level", "file_no", F.col("a.key").alias("lo"), (-F.col("a.s")).alias("lo_seq"), F.col("z.key").alias("hi"), (-F.col("z.s")).alias("hi_seq")))


@query("""SELECT name FROM (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN printf('%06d.log', o_orderkey) WHEN 1 THEN printf('%06d.sst', o_orderkey)
  WHEN 2 THEN printf('%06d.dbtmp', o_orderkey) WHEN 3 THEN printf('MANIFEST-%06d', o_orderkey) WHEN 4 THEN 'CURRENT' ELSE printf('%06d.other', o_orderkey) END AS name FROM orders)
  WHERE CASE k % 6 WHEN 0 THEN k >= 600 OR k = 300 WHEN 3 THEN k >= 903 WHEN 1 THEN k IN (SELECT file_no FROM files) WHEN 2 THEN k IN (SELECT file_no FROM files) ELSE true END""")
def keep_files(spark, d):
    """A directory with one name for each order, against the live files."""
    n = F.col("o_orderkey")
    names = [N.file_name(n, "log"), N.file_name(n, "table"), N.file_name(n, "temp"), N.file_name(n, "manifest"), F.lit("CURRENT"), F.format_string("%06d.other", n)]
    named = table(spark, d, "orders").select(F.element_at(F.array(*names), (n % 6 + 1).cast("int")).alias("name"))
    number, kind = N.parse_file_name(F.col("name"))
    return V.keep_files(named.select("name", number.alias("number"), kind.alias("kind")), files(spark, d), 600, 300, 903)


@query("SELECT file_no, row_number() OVER (ORDER BY file_no DESC) AS place FROM files WHERE level = 0")
def newest_first(spark, d):
    return V.newest_first(files(spark, d))


@query("SELECT level, count(*) AS n_files FROM files GROUP BY level")
def prop_num_files(spark, d):
    return files(spark, d).groupBy("level").agg(F.count("*").alias("n_files"))


@query("SELECT level, file_no, printf(' %d:%d[''%s'' .. ''%s'']', file_no, file_size, lo, hi) AS line FROM files")
def prop_sstables(spark, d):
    return files(spark, d).select("level", "file_no", F.format_string(" %d:%d['%s' .. '%s']", "file_no", "file_size", "lo", "hi").alias("line"))


# Batches


@query("SELECT m + row_number() OVER (ORDER BY n_nationkey) AS seq, printf('nation%04d', n_nationkey) AS key, n_name AS value FROM nation, n")
def apply_batch(spark, d):
    batch = R.global_index(table(spark, d, "nation"), "n_nationkey")
    return batch.select((F.lit(last_seq(ops(spark, d)) + 1) + F.col("idx")).alias("seq"), F.format_string("nation%04d", "n_nationkey").alias("key"), F.col("n_name").alias("value"))


@query("""SELECT CAST(12 + sum(CASE WHEN kind = 1 THEN 2 + length(key) + length(value) + CASE WHEN length(value) < 128 THEN 1 WHEN length(value) < 16384 THEN 2 ELSE 3 END
  ELSE 2 + length(key) END) AS BIGINT) AS bytes FROM ops""")
def batch_size(spark, d):
    """Bytes of the whole log as one batch."""
    from ..sources.batch import encoded_size

    return encoded_size(ops(spark, d))


@query("""SELECT key, is_restart, prev_key, CAST(CASE WHEN is_restart THEN 0 ELSE (SELECT count(*) FROM range(1, 13) p(i) WHERE substr(key, 1, i) = substr(prev_key, 1, i)) END AS BIGINT) AS shared
  FROM (SELECT key, (row_number() OVER (ORDER BY key) - 1) % 16 = 0 AS is_restart, lag(key) OVER (ORDER BY key) AS prev_key FROM vis)""")
def prefix_compress(spark, d):
    """Restart points every 16 keys; other keys share a prefix with the one before."""
    rows = R.global_index(state(spark, d), "key").select("key", (F.col("idx") % 16 == 0).alias("is_restart"), F.col("prev").alias("prev_key"))
    shared = K.common_prefix(F.col("key").cast("binary"), F.col("prev_key").cast("binary"))
    return rows.withColumn("shared", F.when(F.col("is_restart"), 0).otherwise(shared).cast("long"))


@query("""SELECT record, string_agg(part, '' ORDER BY pos) AS data FROM (SELECT seq, key, p AS pos, substr(key, (p - 1) * 5 + 1, 5) AS part, seq AS record
  FROM ops, (SELECT unnest([1, 2, 3]) AS p)) GROUP BY record""")
def log_reassemble(spark, d):
    """Each key cut to fragments of five bytes (first, middle, last) and put together
    by islands of fragments that begin with a first or full one."""
    from ..sources.wal import reassemble

    log = ops(spark, d).select("seq", "key")
    parts = log.select("seq", F.posexplode(F.array(*(F.substring("key", 5 * k + 1, 5) for k in range(3)))).alias("pos", "data"))
    physical = parts.select((F.col("seq") * 3 + F.col("pos")).alias("offset"), F.element_at(F.array(F.lit(2), F.lit(3), F.lit(4)), F.col("pos") + 1).alias("type"), "data", F.floor(F.col("seq") / 1000).alias("log"))
    return reassemble(physical, by="log").select(((F.col("offset")) / 3).cast("long").alias("record"), "data")


# Functions


@query("""SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_name < b.n_name THEN -1 WHEN a.n_name > b.n_name THEN 1 ELSE 0 END AS c FROM nation a, nation b""")
def slice_compare(spark, d):
    n = table(spark, d, "nation")
    # both sides are the fixed table of nations
    return n.select(F.col("n_name").alias("a")).crossJoin(n.select(F.col("n_name").alias("b"))).select("a", "b", K.compare(F.col("a"), F.col("b")).alias("c"))


@query("""SELECT o_orderkey AS v, CAST(CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3
  WHEN o_orderkey < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS len FROM orders""")
def varint_length(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("v"), N.varint_length(F.col("o_orderkey")).alias("len"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN '18446744073709551615' END AS digits,
  CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN '18446744073709551615' END AS number FROM events""")
def consume_decimal(spark, d):
    """Digits alone, digits and a tail, the largest number of 64 bits, one digit more, and none."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.concat(F.col("user_id").cast("string"), F.lit("tail7"))).when(k == 2, "18446744073709551615")
    text = text.when(k == 3, F.lit("184467440737095516150")).otherwise(F.concat(F.lit("tail"), F.col("user_id").cast("string")))
    digits, number = N.consume_decimal(text)
    return table(spark, d, "events").select("event_id", digits.alias("digits"), number.cast("string").alias("number"))


@query("SELECT file_no, printf('%06d.sst', file_no) AS name FROM files")
def make_filename(spark, d):
    return files(spark, d).select("file_no", N.file_name(F.col("file_no"), "table").alias("name"))


@query("""SELECT name, CASE WHEN k < 5 THEN key WHEN k < 9 THEN 0 END AS number,
  CASE k WHEN 0 THEN 'log' WHEN 1 THEN 'table' WHEN 2 THEN 'temp' WHEN 3 THEN 'manifest' WHEN 4 THEN 'table' WHEN 5 THEN 'lock' WHEN 6 THEN 'current' WHEN 7 THEN 'info' WHEN 8 THEN 'info' END AS kind
  FROM (SELECT key, key % 10 AS k, CASE key % 10 WHEN 0 THEN printf('%06d.log', key) WHEN 1 THEN printf('%06d.ldb', key)
  WHEN 2 THEN printf('%06d.dbtmp', key) WHEN 3 THEN printf('MANIFEST-%06d', key) WHEN 4 THEN printf('%06d.sst', key) WHEN 5 THEN 'LOCK' WHEN 6 THEN 'CURRENT'
  WHEN 7 THEN 'LOG' WHEN 8 THEN 'LOG.old' ELSE printf('%06dx.sst', key) END AS name FROM (SELECT o_orderkey AS key FROM orders))""")
def parse_filename(spark, d):
    n = F.col("o_orderkey")
    names = [N.file_name(n, "log"), F.format_string("%06d.ldb", n), N.file_name(n, "temp"), N.file_name(n, "manifest"), N.file_name(n, "table"), *map(F.lit, ("LOCK", "CURRENT", "LOG", "LOG.old")), F.format_string("%06dx.sst", n)]
    named = table(spark, d, "orders").select(F.element_at(F.array(*names), (n % 10 + 1).cast("int")).alias("name"))
    number, kind = N.parse_file_name(F.col("name"))
    return named.select("name", number.alias("number"), kind.alias("kind"))


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS key FROM orders")
def bench_keys(spark, d):
    return table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 16, "0").alias("key"))


@query("""SELECT CAST(CASE WHEN value <= 1 THEN 0 ELSE least(127, CAST(ceil(log2(value) * 4) AS BIGINT)) END AS BIGINT) AS bucket, count(*) AS c
  FROM events GROUP BY 1""")
def latency_histogram(spark, d):
    return H.buckets(table(spark, d, "events"), "value")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, min(value) AS least, max(value) AS most FROM events GROUP BY event_type""")
def latency_summary(spark, d):
    out = H.summary(table(spark, d, "events"), "value", ["event_type"]).drop("p50", "p95", "p99")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("""SELECT event_type, CAST(p AS BIGINT) AS p, least(greatest(CASE WHEN min(bucket) = 0 THEN 1.0 ELSE pow(2.0, min(bucket) / 4.0) END, any_value(lo)), any_value(hi)) AS latency FROM
 (SELECT event_type, bucket, lo, hi, n, sum(c) OVER (PARTITION BY event_type ORDER BY bucket) AS upto FROM
  (SELECT event_type, CASE WHEN value <= 1 THEN 0 ELSE least(127, CAST(ceil(log2(value) * 4) AS BIGINT)) END AS bucket, count(*) AS c,
   min(min(value)) OVER (PARTITION BY event_type) AS lo, max(max(value)) OVER (PARTITION BY event_type) AS hi, sum(count(*)) OVER (PARTITION BY event_type) AS n
   FROM events GROUP BY 1, 2)), (SELECT unnest([50, 95, 99]) AS p) WHERE upto >= (n * p + 99) // 100 GROUP BY event_type, p""")
def latency_percentiles(spark, d):
    wide = H.summary(table(spark, d, "events"), "value", ["event_type"])
    return wide.unpivot(["event_type"], ["p50", "p95", "p99"], "q", "latency").select("event_type", F.substring("q", 2, 2).cast("long").alias("p"), "latency")


@query("""SELECT user_id, CAST(sum(length(props)) AS BIGINT) AS bytes, round(CAST(sum(length(props)) AS DOUBLE) / nullif(sum(value), 0), 6) AS rate FROM events GROUP BY user_id""")
def throughput(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.length("props")).alias("bytes"), F.sum("value").alias("t"))
    return e.select("user_id", "bytes", F.round(F.col("bytes").cast("double") / F.nullif("t", F.lit(0.0)), 6).alias("rate"))


_MUL = "((({0}) * 3332679571) & 4294967295)"
_W = "(ascii(substr(key,{0},1)) + (ascii(substr(key,{1},1)) << 8) + (ascii(substr(key,{2},1)) << 16) + (ascii(substr(key,{3},1))::HUGEINT << 24))"


_HASH = f"""k AS (SELECT DISTINCT key FROM {{source}}),
 s0 AS (SELECT key, xor(3164544308::HUGEINT, {_MUL.format('12::HUGEINT')}) AS h FROM k),
 a1 AS (SELECT key, {_MUL.format('(h + ' + _W.format(1, 2, 3, 4) + ') & 4294967295')} AS h FROM s0), b1 AS (SELECT key, xor(h, h >> 16) AS h FROM a1),
 a2 AS (SELECT key, {_MUL.format('(h + ' + _W.format(5, 6, 7, 8) + ') & 4294967295')} AS h FROM b1), b2 AS (SELECT key, xor(h, h >> 16) AS h FROM a2),
 a3 AS (SELECT key, {_MUL.format('(h + ' + _W.format(9, 10, 11, 12) + ') & 4294967295')} AS h FROM b2),
 hashed AS (SELECT key, CAST(xor(h, h >> 16) AS BIGINT) AS hash FROM a3)"""
_SIZE = "bits AS (SELECT ((greatest(64, count(DISTINCT key) * 10) + 7) // 8) * 8 AS m FROM ops)"
_PROBES = "SELECT DISTINCT key, ((hash + ((hash >> 17) | ((hash << 15) & 4294967295)) * j) & 4294967295) % m AS bit FROM hashed, bits, range(0, 6) p(j)"


@query(f"{BASE}, {_HASH.format(source='ops')} SELECT key, hash FROM hashed")
def hash32(spark, d):
    return ops(spark, d).select("key").distinct().select("key", N.hash32(F.col("key").cast("binary")).alias("hash"))


@query(f"{BASE}, {_HASH.format(source='ops')}, {_SIZE} SELECT DISTINCT bit FROM ({_PROBES})")
def bloom_bits(spark, d):
    """The bits of one filter over all keys, at ten bits a key: bit positions that are set."""
    keys = ops(spark, d).select("key").distinct()
    bits = N.bloom_size(keys.count(), 10)
    return keys.select(F.explode(N.bloom_bits(F.col("key").cast("binary"), F.lit(bits), N.bloom_probes(10))).alias("bit")).distinct()


@query(f"""{BASE}, {_HASH.format(source='ops')}, {_SIZE}, stored AS (SELECT DISTINCT bit FROM ({_PROBES})),
 {_HASH.format(source="(SELECT printf('user%08d', c_custkey) AS key FROM customer)").replace('k AS', 'k2 AS', 1).replace('FROM k)', 'FROM k2)').replace('s0', 't0').replace('a1', 'c1').replace('b1', 'd1').replace('a2', 'c2').replace('b2', 'd2').replace('a3', 'c3').replace('hashed', 'asked')}
 SELECT key, bool_and(stored.bit IS NOT NULL) AS may_match FROM ({_PROBES.replace('FROM hashed', 'FROM asked')}) a LEFT JOIN stored ON stored.bit = a.bit GROUP BY key""")
def bloom_probe(spark, d):
    """Customers' keys against the filter: all bits set means that the key may be there."""
    keys = ops(spark, d).select("key").distinct()
    bits = N.bloom_size(keys.count(), 10)
    asked = customer_keys(spark, d).distinct().select("key", F.explode(F.array_distinct(N.bloom_bits(F.col("key").cast("binary"), F.lit(bits), N.bloom_probes(10)))).alias("bit"))
    hits = asked.join(bloom_bits(spark, d).withColumn("is_set", F.lit(1)), "bit", "left")
    return hits.groupBy("key").agg((F.count("*") == F.sum(F.coalesce("is_set", F.lit(0)))).alias("may_match"))


@query("""SELECT o_orderkey AS crc, CAST((((o_orderkey >> 15) | ((o_orderkey::HUGEINT << 17) & 4294967295)) + 2726488792) & 4294967295 AS BIGINT) AS masked,
  o_orderkey AS unmasked FROM orders""")
def crc_mask(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("crc"))
    return rows.withColumn("masked", N.crc_mask(F.col("crc"))).withColumn("unmasked", N.crc_unmask(F.col("masked")))


@query(f"""WITH RECURSIVE {BASE.strip().removeprefix('WITH ')}, t(i, v) AS (VALUES {", ".join(f"({i}, {v})" for i, v in enumerate(CRC_TABLE))}),
 walk AS (SELECT DISTINCT key, 0 AS p, CAST(4294967295 AS BIGINT) AS c FROM ops
  UNION ALL SELECT key, p + 1, xor(t.v, c >> 8) FROM walk JOIN t ON t.i = (xor(c, ascii(substr(key, p + 1, 1))) & 255) WHERE p < length(key))
 SELECT key, xor(c, 4294967295) AS crc FROM walk WHERE p = length(key)""")
def crc32c(spark, d):
    return ops(spark, d).select("key").distinct().select("key", crc32c_col(F.col("key").cast("binary")).alias("crc"))


@query("""SELECT k.key, n.next, CASE WHEN i IS NULL OR ascii(substr(k.key, i, 1)) + 1 >= ascii(substr(n.next, i, 1)) THEN k.key
  ELSE substr(k.key, 1, i - 1) || chr(ascii(substr(k.key, i, 1)) + 1) END AS separator
  FROM (SELECT key FROM vis) k JOIN (SELECT key, lead(key) OVER (ORDER BY key) AS next FROM vis) n ON k.key = n.key
  LEFT JOIN (SELECT a.key, min(p) AS i FROM (SELECT key, lead(key) OVER (ORDER BY key) AS nx FROM vis) a, (SELECT unnest(range(1, 13)) AS p)
  WHERE substr(a.key, p, 1) <> substr(nx, p, 1) GROUP BY a.key) f ON f.key = k.key WHERE n.next IS NOT NULL""")
def shortest_separator(spark, d):
    pairs = R.global_index(state(spark, d), "key").where("prev is not null").select(F.col("prev").alias("key"), F.col("key").alias("next"))
    return pairs.select("key", "next", K.shortest_separator(F.col("key").cast("binary"), F.col("next").cast("binary")).cast("string").alias("separator"))


@query("SELECT key, chr(ascii(substr(key, 1, 1)) + 1) AS successor FROM vis")
def short_successor(spark, d):
    return state(spark, d).select("key", K.short_successor(F.col("key").cast("binary")).cast("string").alias("successor"))


@query(r"""SELECT key, seq, key || '\x00\x0a\x1f ~\x7f\xc3\xa9\' || coalesce(value, '') AS escaped FROM ops""")
def escape_string(spark, d):
    """The values with bytes around them that are and that are not printable."""
    return ops(spark, d).select("key", "seq", K.escape(F.concat(F.col("key"), F.lit("\x00\n\x1f ~\x7fé\\"), F.coalesce("value", F.lit(""))).cast("binary")).alias("escaped"))


@query("""SELECT o_orderkey AS v, lpad(to_hex(o_orderkey), 8, '0')[7:8] || lpad(to_hex(o_orderkey), 8, '0')[5:6] || lpad(to_hex(o_orderkey), 8, '0')[3:4] || lpad(to_hex(o_orderkey), 8, '0')[1:2] AS fixed32,
  o_orderkey AS decoded FROM orders""")
def fixed_coding(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("v"), K.fixed(F.col("o_orderkey"), 4).alias("f32"), K.fixed(F.col("o_orderkey"), 8).alias("f64"))
    return rows.select("v", F.hex("f32").alias("fixed32"), K.fixed_value(F.col("f64"), F.lit(0), 8).alias("decoded"))


def _tags(spark, d) -> DataFrame:
    rows = ops(spark, d).select("key", "seq", "kind")
    return rows.withColumn("internal", K.internal_key(F.col("key").cast("binary"), F.col("seq"), F.col("kind")))


@query("""SELECT key, seq, hex(encode(key)) || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS internal
  FROM (SELECT key, seq, lpad(to_hex(seq * 256 + kind), 16, '0') AS h FROM ops)""")
def internal_key_encode(spark, d):
    return _tags(spark, d).select("key", "seq", F.hex("internal").alias("internal"))


@query("""SELECT seq AS op, CASE WHEN seq % 5 >= 2 THEN key END AS key, CASE WHEN seq % 5 >= 2 THEN seq END AS seq, CASE WHEN seq % 5 >= 2 THEN kind END AS kind, seq % 5 >= 2 AS valid FROM ops""")
def internal_key_parse(spark, d):
    """Of five keys, one is cut to seven bytes and one has a kind that is not known."""
    cut, odd = F.col("seq") % 5 == 0, F.col("seq") % 5 == 1
    n = F.length("internal")
    other = F.concat(F.substring("internal", F.lit(1), n - 8), F.lit(bytearray(b"\x02")), F.substring("internal", n - 6, F.lit(7)))
    rows = _tags(spark, d).select(F.col("seq").alias("op"), F.when(cut, F.substring("internal", 1, 7)).when(odd, other).otherwise(F.col("internal")).alias("internal"))
    out = rows.select("op", *(c.alias(n) for n, c in K.internal_key_parts(F.col("internal")).items()))
    return out.withColumn("key", F.col("key").cast("string"))


@query("""WITH RECURSIVE r AS (SELECT n_nationkey AS seed, 0 AS i, CAST(CASE WHEN n_nationkey = 0 THEN 1 ELSE n_nationkey END AS BIGINT) AS x FROM nation
  UNION ALL SELECT seed, i + 1, x * 16807 % 2147483647 FROM r WHERE i < 21)
  SELECT a.seed, a.x AS number, a.x % 100 AS below_100, a.x % 10 = 0 AS one_in_10, b.x % CAST(pow(2, a.x % 11) AS BIGINT) AS skewed_10
  FROM r a JOIN r b ON a.seed = b.seed AND a.i = 20 AND b.i = 21""")
def lehmer_random(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("seed"), *(N.lehmer(F.col("n_nationkey"), F.lit(k)).alias(n) for k, n in ((20, "number"), (21, "following"))))
    x, y = F.col("number"), F.col("following")
    return rows.select("seed", "number", N.uniform(x, 100).alias("below_100"), N.one_in(x, 10).alias("one_in_10"), N.skewed(x, y, 10).alias("skewed_10"))


@query("""SELECT file_no, seq, '''' || key || ''' @ ' || seq || ' : ' || CASE kind WHEN 1 THEN 'val' ELSE 'del' END || ' => ''' || coalesce(value, '') || '''' AS line FROM seg""")
def dump_table(spark, d):
    from ..sources.dump import table_lines

    return table_lines(binary(segments(spark, d), "key", "value")).select("file_no", "seq", "line")


@query("""SELECT seq, CASE kind WHEN 1 THEN '  put ''' || key || ''' ''' || value || '''' ELSE '  del ''' || key || '''' END AS line FROM ops""")
def dump_log(spark, d):
    from ..sources.dump import log_lines

    return log_lines(binary(ops(spark, d), "key", "value")).select("seq", "line")


@query("SELECT key, seq, kind, value FROM ops")
def wal_decode(spark, d):
    """The whole op log written as binary logs, one for each input partition, and read
    back through the data source."""
    from ..sources.wal import read_wal, write_wal
    from ..store import scratch

    path = scratch(spark, "wal")
    write_wal(binary(ops(spark, d), "key", "value"), path)
    out = read_wal(spark, path)
    return out.select(F.col("key").cast("string").alias("key"), "seq", F.col("kind").cast("int").alias("kind"), F.col("value").cast("string").alias("value"))


@query("SELECT key, value FROM vis")
def store_round_trip(spark, d):
    """The op log loaded into a store in four segments, compacted, and read back."""
    from ..store import KVStore, scratch

    log = binary(ops(spark, d), "key", "value")
    last = last_seq(log)
    with KVStore.open(spark, scratch(spark, "store"), create_if_missing=True) as db:
        for k in range(4):
            db.append_ops(log.where((F.col("seq") * 4 / (last + 1)).cast("int") == k))
        db.compact()
        return db.state().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT key, value FROM vis")
def stream_state(spark, d):
    """The op log as a stream of changes, folded to the newest entry of each key."""
    from ..store import scratch
    from ..streaming.ingest import replay

    log = binary(ops(spark, d), "key", "value")
    out = replay(spark, log, scratch(spark, "stream"))
    return out.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), "seq", F.col("kind").cast("int").alias("kind"), F.col("value").cast("string").alias("value"))


@query("SELECT key, seq, kind, value FROM ops")
def table_round_trip(spark, d):
    """The whole op log as sorted tables (prefix-compressed blocks, index, filters, footer),
    written to the shared folder and read back block by block."""
    from ..sources.sst import decode_tables, encode_tables
    from ..store import scratch

    path = scratch(spark, "tables")
    encode_tables(binary(ops(spark, d), "key", "value"), compression="snappy", bits_per_key=10).write.parquet(path)
    return _text(decode_tables(spark.read.parquet(path), paranoid=True))


@query("SELECT key, seq, kind, value FROM ops")
def batch_round_trip(spark, d):
    """The op log as encoded batches of a thousand, taken apart again."""
    from ..sources.batch import batch_rows, encode_batches

    log = binary(ops(spark, d), "key", "value").withColumn("batch", F.floor((F.col("seq") - 1) / 1000))
    return _text(batch_rows(encode_batches(log, "batch", "seq")))


@query("SELECT level, file_no, file_size, lo, hi FROM files")
def edit_round_trip(spark, d):
    """The files of each level as one version edit, encoded, decoded and folded."""
    from ..sources.edits import decode_files, encode_files

    f = files(spark, d).select("level", "file_no", "file_size", F.col("lo").cast("binary").alias("lo"), F.col("hi").cast("binary").alias("hi"))
    return decode_files(encode_files(f)).withColumns({c: F.col(c).cast("string") for c in ("lo", "hi")})


@query("""SELECT key, value FROM (SELECT ops.*, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS rn
  FROM ops, n WHERE seq <= m // 2) WHERE rn = 1 AND kind = 1""")
def store_snapshot(spark, d):
    """The state at a snapshot that was taken half way, after more ops and a compaction."""
    from ..store import KVStore, scratch

    log = binary(ops(spark, d), "key", "value")
    half = last_seq(log) // 2
    with KVStore.open(spark, scratch(spark, "store"), create_if_missing=True) as db:
        db.append_ops(log.where(F.col("seq") <= half))
        seen = db.snapshot()
        db.append_ops(log.where(F.col("seq") > half))
        db.compact()
        return db.state(seen).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("""SELECT l.key, v.value, v.key IS NOT NULL AS found
  FROM (SELECT DISTINCT printf('user%08d', c_custkey) AS key FROM customer) l LEFT JOIN vis v ON l.key = v.key""")
def store_multi_get(spark, d):
    """Lookups in a store of bulk batches: the ops arrive shuffled, their order beside them."""
    from ..store import KVStore, scratch

    log = binary(ops(spark, d), "key", "value").withColumn("ord", F.col("seq"))
    with KVStore.open(spark, scratch(spark, "store"), create_if_missing=True) as db:
        db.bulk_write(log.repartition(F.hash("value")))
        db.compact()
        out = db.multi_get(binary(customer_keys(spark, d), "key"))
        return out.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


@query("SELECT level, file_no, CASE WHEN level = 0 THEN 'NotFound: ' || file_no || ': gone' ELSE 'NotFound: ' || file_no END AS status FROM files", name="status_text")
def status_text(spark, d):
    """Errors as texts: code, message and, if there is one, detail."""
    from ..model import status

    return files(spark, d).select("level", "file_no", status("NotFound", F.col("file_no").cast("string"), F.when(F.col("level") == 0, F.lit("gone"))).alias("status"))

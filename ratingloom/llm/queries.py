"""One registered query per operator, with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratingloom.llm import (
    chat,
    decontam,
    katz,
    line_templates,
    mixing,
    near_dups,
    neighbours,
    packing,
    periodic_runs,
    pii,
    prefix_trie,
    token_counts,
    toxicity,
)
from ratingloom.llm.store import WORD, cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


DECONTAM_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[pos:pos + 9], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS pos FROM item_words WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, pos, n, array_to_string(words[pos:pos + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM doc_words, lengths WHERE len(words) >= n)),
found AS (SELECT doc_id, item_id, pos, p.n FROM places AS p JOIN windows USING (win)),
hits AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS at_word FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


@_query("op4_decontamination", DECONTAM_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_ESCAPES = " + ".join(
    f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ("\\", *_CONTROLS)
)
CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles,
    sum(33 + length(role) + {_ESCAPES.format('role')} + length(text) + {_ESCAPES.format('text')}) AS chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?u(au)*a?') AS valid
FROM grouped"""


@_query("op5_chat_format", CHAT_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.chat_digest(chat.format_chats(turns))


@_query("op6_mix_sources")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(parts))) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
tokens AS (
  SELECT doc_id, place, regexp_extract_all(
    CASE WHEN regexp_matches(line, '[0-9]')
      THEN regexp_replace(line, '[^\x20\x09\x0B-\x0D]*[0-9][^\x20\x09\x0B-\x0D]*', '<*>', 'g') ELSE line END,
    '[^\x20\x09\x0B-\x0D]+') AS t FROM lines),
judged AS (
  SELECT *, len(t) AS n, CAST(ceil((len(t) - 3) / 4.0) AS BIGINT) AS step, len(t) >= 8 OR length(array_to_string(t, ' ')) >= 48 AS long
  FROM tokens WHERE len(t) >= 1),
keyed AS (
  SELECT doc_id, place, n, long, -1 AS part, t AS head, CAST([] AS VARCHAR[]) AS tail FROM judged
  UNION ALL
  SELECT doc_id, place, n, long, part, t[1:least(3 + part * step, n)], t[least(3 + part * step + step, n) + 1:n]
  FROM judged, (SELECT unnest(range(0, 4)) AS part) WHERE n >= 8),
recurring AS (
  SELECT part, n, head, tail, min(struct_pack(d := doc_id, p := place)) AS first FROM keyed GROUP BY part, n, head, tail
  HAVING count(DISTINCT doc_id) >= CASE WHEN bool_or(long) THEN 2 ELSE 5 END),
dropped AS (
  SELECT DISTINCT doc_id, place FROM keyed JOIN recurring USING (part, n, head, tail)
  WHERE doc_id <> first.d OR place <> first.p),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(d.place) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY l.place) FILTER (d.place IS NULL), '') AS text
  FROM lines AS l LEFT JOIN dropped AS d USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE kept.text END AS text
FROM documents AS d LEFT JOIN kept USING (doc_id)"""


@_query("op10_line_templates", LINES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


@_query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    kinds = [counted(kind) for kind in pii.KINDS]
    return found.select("doc_id", *kinds, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@_query("op1_nearest")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


NEAR_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS pos FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT b, root FROM reach JOIN links ON a = node),
roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents AS d JOIN roots ON d.doc_id = node LEFT JOIN sizes ON sizes.doc_id = d.doc_id"""


@_query("op8_near_duplicates", NEAR_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@_query("op9_katz")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    def learned(doc_id):
        return F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2

    return katz.katz_scores(table(spark, sf_dir, "documents"), learned)


@_query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs.where(toxicity.learned_from(F.col("doc_id"))), labels)
    scored = toxicity.toxicity(docs, machine)
    return scored.select("doc_id", (~toxicity.learned_from(F.col("doc_id"))).alias("held_out"), "score", "predicted")


# unsigned crc32 of a decimal number, byte by byte and bit by bit
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    md5(length(role) || ':' || role || text) AS mark, length(text) AS chars
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, {_CRC_SQL.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT i.conv_id, pos, mark, chars FROM ids AS i JOIN turns AS t ON t.conv_id = i.conv_id - i.conv_id % 100 AND pos <= h
  UNION ALL
  SELECT t.conv_id, pos - h + (SELECT count(*) FROM turns AS b WHERE b.conv_id = t.conv_id - t.conv_id % 100 AND b.pos <= h), mark, chars
  FROM turns AS t JOIN ids USING (conv_id) WHERE pos > h),
prefixes AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM ids
  UNION ALL
  SELECT conv_id, pos, string_agg(mark, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos), chars FROM rebuilt),
lengths AS (SELECT conv_id, max(depth) AS turns FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT path, depth, min(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = turns), '') AS ends
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY path, depth),
children AS (SELECT p.path, count(*) AS n FROM nodes AS c JOIN nodes AS p ON p.path = substr(c.path, 1, 32 * (c.depth - 1)) AND c.depth > 0 GROUP BY p.path),
above AS (SELECT path, chars, n_convs, unnest(range(0, depth + 1)) AS up FROM nodes),
subtrees AS (
  SELECT substr(a.path, 1, 32 * up) AS path, count(*) FILTER (n IS NULL) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM above AS a LEFT JOIN children USING (path) GROUP BY ALL)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(n, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  sha256(v.ends) AS ends_sha256
FROM nodes AS v JOIN subtrees USING (path) LEFT JOIN children USING (path)
LEFT JOIN nodes AS p ON v.depth > 0 AND p.path = substr(v.path, 1, 32 * (v.depth - 1))"""


def rebuilt_marks(marks: DataFrame, members: DataFrame) -> DataFrame:
    """Every conversation c opened by the first h turns of conversation c - c % 100, its own first h left out."""
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    asked = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (crc % 6).alias("h"))
    heads = marks.where("conv_id % 100 = 0 AND position <= 5").withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    moved = asked.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0))))
    opened = asked.join(heads, "base").where("position <= h").select("conv_id", "position", "mark", "chars")
    own = marks.join(moved, "conv_id").where("position > h")
    placed = (F.col("position") - F.col("h") + F.col("taken")).cast("int").alias("position")
    return opened.unionByName(own.select("conv_id", placed, "mark", "chars"))


@_query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = cut(prefix_trie.turn_marks(table(spark, sf_dir, "conversations")))
    members = marks.select("conv_id").distinct()
    trie = prefix_trie.prefix_trie(rebuilt_marks(marks, members), members)
    counts = ("n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    nodes = trie.nodes.join(prefix_trie.end_digests(trie.ends), "path", "left")
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *counts, digest)


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of every tenth checksum continue periodically from a place on that the checksum names."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def continued(words):
        n = F.size(words).cast("long")
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))

        def at(i):
            return F.get(words, F.when(i < a, i).otherwise(a + (i - a) % period).cast("int"))

        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at), " "))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # one element, so that the words are found once
    made = F.get(F.transform(F.array(words), continued), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(made, "text")).otherwise(F.col("text")).alias("text"))


@_query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic_runs.most_periodic(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@_query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )

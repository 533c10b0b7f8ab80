"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe, cover_tree, decontaminate, dialogue, html_text, jaccard, language, merkle, passages, pii, ranked_search, shards, token_counts
from pairloom.llm.common import table

# Parameters of the registered queries; a job passes its own.
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PII_KEY = "registered query"
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the tokenizer file of a registered query lies; jobs pass a path of their own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.digest(found)


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.load(tokenizer_path()))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return dialogue.perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ","))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS).select("doc_id", "slot", "shard", "shard_name")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.held_out("doc_id")
    model = language.learn(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), token_counts.load(tokenizer_path(BYTE_TOKENIZER)), keep=["doc_id"])


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_pii_pseudonyms, op3_bpe_trie, op4_cover_tree, op5_perspectives, op6_passages, op7_shards,
        op8_ngram_jaccard, op9_language, op10_html_text, op11_token_counts, op12_merkle, op13_ranked_search,
    )
}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# ``linked(a, b)`` both ways to the smallest id each id reaches
REACH = """
    reach(id, other) AS (
      SELECT a, b FROM linked UNION SELECT r.id, l.b FROM reach r JOIN linked l ON l.a = r.other)"""



def written(field: str) -> str:
    """A field as the Merkle leaves write it: length in bytes, colon, text; a dash for NULL."""
    return f"coalesce(CAST(strlen({field}) AS VARCHAR) || ':' || {field}, '-')"


ORACLES: dict[str, str] = {
    "op1_decontaminate": rf"""
    WITH docs AS (
      SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
    items AS (
      SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
    windows AS (
      SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g
      FROM (SELECT *, least(10, len(w)) AS m FROM items WHERE len(w) > 0), unnest(range(1, len(w) - m + 2)) AS t(i)),
    grams AS (
      SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
      FROM docs, (SELECT DISTINCT m FROM windows), unnest(range(1, len(w) - m + 2)) AS t(i)),
    hits AS (SELECT doc_id, i, m, item_id FROM grams JOIN windows USING (m, g)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + m)) AS t(p) GROUP BY doc_id),
    ids AS (
      SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha
      FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)
    """,
    "op4_cover_tree": f"""
    WITH RECURSIVE good AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
    linked AS (
      SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.vec_id <> q.vec_id
      WHERE list_cosine_similarity(p.v, q.v) >= 0.98),
    {REACH}
    SELECT e.vec_id, (SELECT count(*) FROM linked l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
      e.vec_id <= coalesce(m, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN (SELECT id, min(other) AS m FROM reach GROUP BY id) r ON r.id = e.vec_id
    """,
    "op5_perspectives": """
    WITH said AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations),
    seen AS (
      SELECT s.*, v.perspective, place // 64 AS part, role = v.perspective AS learn,
        CASE WHEN role = 'system' THEN '<|system|>' WHEN role = v.perspective THEN '<|assistant|>' ELSE '<|user|>' || role END || chr(10) AS open,
        text || '<|end|>' || chr(10) AS body
      FROM said s JOIN (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system') v USING (conv_id)),
    placed AS (
      SELECT *, sum(length(open) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY place) AS stop FROM seen)
    SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, min_by(turn, place) AS first_turn, count(*) AS n_turns,
      string_agg(open || body, '' ORDER BY place) AS rendered,
      coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY place) FILTER (learn), '') AS mask,
      CAST(sum(length(open) + length(body)) AS BIGINT) AS n_chars
    FROM placed GROUP BY conv_id, perspective, part
    """,
    "op8_ngram_jaccard": rf"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    grams AS (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
      FROM docs, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common AS (
      SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM grams p JOIN grams q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
    linked AS (
      SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
    {REACH}
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
    FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(other) AS m FROM reach GROUP BY id) r ON r.id = d.doc_id
    """,
    "op12_merkle": f"""
    WITH RECURSIVE written AS (
      SELECT doc_id, lang,
        list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
          lambda crc, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, b)),
          CAST(4294967295 AS BIGINT)) AS crc,
        {written("CAST(doc_id AS VARCHAR)")} || {written("source")} || {written("lang")} || {written("CAST(n_chars AS VARCHAR)")} AS head,
        {written("text")} AS tail, {written(LOWER)} AS small
      FROM documents),
    leaves AS (
      SELECT doc_id, lang, sha256(head || tail) AS leaf, sha256(head || CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN small ELSE tail END) AS claimed,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place FROM written),
    below AS (
      SELECT 0 AS level, lang, place // 8 AS run, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY lang, place // 8
      UNION ALL
      SELECT level + 1, lang, run // 8, list(sha256(array_to_string(nodes, '')) ORDER BY run)
      FROM (SELECT *, max(run) OVER (PARTITION BY lang) AS last, max(len(nodes)) OVER (PARTITION BY lang) AS widest FROM below)
      WHERE last > 0 OR widest > 1 GROUP BY level, lang, run // 8),
    subroots AS (SELECT lang, nodes[1] AS subroot FROM below b WHERE len(nodes) = 1 AND level = (SELECT max(level) FROM below c WHERE c.lang IS NOT DISTINCT FROM b.lang)),
    placed AS (SELECT lang, subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM subroots),
    above AS (
      SELECT 0 AS level, place // 8 AS run, list(subroot ORDER BY place) AS nodes FROM placed GROUP BY place // 8
      UNION ALL
      SELECT level + 1, run // 8, list(sha256(array_to_string(nodes, '')) ORDER BY run)
      FROM (SELECT *, max(run) OVER () AS last, max(len(nodes)) OVER () AS widest FROM above) WHERE last > 0 OR widest > 1 GROUP BY level, run // 8),
    whole AS (SELECT nodes[1] AS root FROM above WHERE level = (SELECT max(level) FROM above)),
    up AS (
      SELECT doc_id, lang, 0 AS level, place, claimed AS h, '' AS proof FROM leaves
      UNION ALL
      SELECT doc_id, u.lang, u.level + 1, u.place // 8, sha256(array_to_string(nodes[: u.place % 8] || [h] || nodes[u.place % 8 + 2 :], '')),
        proof || array_to_string(nodes[: u.place % 8] || nodes[u.place % 8 + 2 :], '')
      FROM up u JOIN below b ON b.lang IS NOT DISTINCT FROM u.lang AND b.level = u.level AND b.run = u.place // 8
      WHERE EXISTS (SELECT 1 FROM below c WHERE c.lang IS NOT DISTINCT FROM u.lang AND c.level = u.level + 1)),
    climbed AS (SELECT doc_id, lang, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM up GROUP BY doc_id, lang),
    climbing AS (
      SELECT doc_id, 0 AS level, place, h, proof FROM climbed c JOIN placed p ON p.lang IS NOT DISTINCT FROM c.lang
      UNION ALL
      SELECT doc_id, o.level + 1, o.place // 8, sha256(array_to_string(nodes[: o.place % 8] || [h] || nodes[o.place % 8 + 2 :], '')),
        proof || array_to_string(nodes[: o.place % 8] || nodes[o.place % 8 + 2 :], '')
      FROM climbing o JOIN above a ON a.level = o.level AND a.run = o.place // 8 WHERE o.level < (SELECT max(level) FROM above)),
    ended AS (SELECT doc_id, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM climbing GROUP BY doc_id)
    SELECT l.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN ended e USING (doc_id), whole
    """,
    "op13_ranked_search": rf"""
    WITH said AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM documents),
    tfs AS (SELECT doc_id, term, count(*) AS tf FROM said GROUP BY doc_id, term),
    sizes AS (SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term, docs),
    asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
    scores AS (
      SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
      FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id),
    ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10
    """,
}

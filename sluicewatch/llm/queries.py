"""Registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicewatch.llm import (
    adaptive_rules,
    chat_bytes,
    lexical_dag,
    line_crf,
    metric_cells,
    ngram_join,
    prefix_trie,
    sp_wfst,
    suffix_arrays,
    token_orc,
    toxicity,
    warc_zstd,
    wrappers,
)
from sluicewatch.llm.labelled import remainder
from sluicewatch.llm.scratch import new_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
TRICKY = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_arrays.find_matches(docs, table(spark, sf_dir, "benchmark"))
    return suffix_arrays.contaminated(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "warc")
    dictionary = warc_zstd.train_dictionary(pages)
    warc_zstd.write_archives(warc_zstd.prepared(pages), dictionary, folder)
    records = warc_zstd.read_archives(spark, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    held_out = (remainder("doc_id", toxicity.HELD_OUT) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = adaptive_rules.apply_rules(docs)
    return judged.select("doc_id", *adaptive_rules.COUNTS, "base_failed", "kept")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), folder, path)
    rows = token_orc.with_crc(token_orc.placed(token_orc.read_tokens(spark, folder)))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = wrappers.extract(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    formatted = stored(chat_bytes.format_conversations(rows.unionByName(more)), "chats")
    return chat_bytes.digests(formatted)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.fit_model(docs, table(spark, sf_dir, "labels"))
    held_out = (remainder("doc_id", line_crf.HELD_OUT) == line_crf.HELD_OUT_REST).alias("held_out")
    return line_crf.score(docs, model).select("doc_id", held_out, "score", "predicted")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every text: what is decoded is the text, marks as blanks."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    text = F.coalesce("text", F.lit(""))
    blanks = F.sha2(F.replace(text, F.lit(sp_wfst.MARK), F.lit(" ")).cast("binary"), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", blanks.alias("text_sha256"))
    rows = sp_wfst.digests(sp_wfst.encode(docs, path).drop("text"), path)
    trip = (F.col("decoded_sha256") == F.col("text_sha256")).alias("round_trip")
    return rows.select("doc_id", "n_pieces", "ids_crc32", "decoded_sha256", trip)


def embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_cells.near_duplicates(table(spark, sf_dir, "embeddings"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(own))


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_dag.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": decontamination,
        "op2_warc": warc,
        "op3_toxicity": toxic_scores,
        "op4_quality_rules": quality_rules,
        "op5_token_orc": tokens,
        "op6_main_text": main_text,
        "op7_ngram_join": near_duplicates,
        "op8_chat_bytes": chats,
        "op9_line_crf": quality_scores,
        "op10_sentencepiece": pieces,
        "op11_metric_cells": embedding_duplicates,
        "op12_prefix_trie": conversation_trie,
        "op13_lexical_search": lexical_search,
    }


_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK_WORD = r"[^\x20\x09-\x0D]+"


def oracle_sql() -> dict[str, str]:
    def words(pattern: str) -> str:
        return f"regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{pattern}')"

    decontaminated = f"""
    WITH items AS (
      SELECT CAST(item_id AS VARCHAR) AS item, {words(_WORD)} AS w FROM benchmark),
    windows AS (
      SELECT item, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS gram,
             least(13, len(w)) AS size
      FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM items WHERE len(w) > 0) AS x),
    sizes AS (SELECT DISTINCT size FROM windows),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {words(_WORD)} AS w FROM documents),
    found AS (
      SELECT DISTINCT r, s, size, item FROM (
        SELECT r, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS gram
        FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
              FROM docs CROSS JOIN sizes WHERE len(w) >= size) AS x) AS y
      JOIN windows USING (gram, size)),
    hits AS (
      SELECT r, count(DISTINCT p) AS n_hit
      FROM (SELECT r, unnest(generate_series(s, s + size - 1)) AS p FROM (SELECT DISTINCT r, s, size FROM found) AS f) AS g
      GROUP BY r),
    named AS (
      SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT r, item FROM found) AS f GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""

    archived = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, octet_length(encode(html)) AS size, sha256(html) AS digest FROM p),
    r AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM q)
    SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM r"""

    linked = f"""
    WITH RECURSIVE docs AS (SELECT doc_id, {words(_BLANK_WORD)} AS w FROM documents),
    sets AS (
      SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(5, len(w)) - 1), ' ') AS gram
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS s FROM docs WHERE len(w) > 0) AS x),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets AS x JOIN sets AS y USING (gram)
      WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (
      SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
      WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
    reach AS (
      SELECT doc_id AS a, doc_id AS b FROM documents
      UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT reach.a AS doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
    FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.a GROUP BY reach.a"""

    escaped = "replace(replace(replace({0}, '\\', '\\\\'), '#', '\\#'), '<', '\\<')"
    role = f"replace({escaped.format('role')}, ':', '\\:')"
    formatted = f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length('### ' || {role} || ': ' || {escaped.format('text')} || '</turn>' || chr(10))) AS BIGINT)
        AS formatted_chars
    FROM c GROUP BY conv_id"""

    ratio = (1 + adaptive_rules.ERROR) / (1 - adaptive_rules.ERROR)

    def num(x: float) -> str:
        return f"CAST('{x!r}' AS DOUBLE)"

    def quantile(q: float) -> str:
        return f"min(CASE WHEN below >= total * {num(q)} THEN bucket END)"

    def edge(bucket: str, upper: bool) -> str:
        power = f"1e-4 * pow({num(ratio)}, {bucket} - {1 if upper else 2})"
        return f"CASE WHEN {bucket} = 0 THEN {'1e-4' if upper else '0'} ELSE {power} END"

    def tails(name: str, keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        return f"""
    {name} AS (
      SELECT {by}, CAST(any_value(total) AS DOUBLE) AS n, {edge(quantile(1 - adaptive_rules.TAIL), False)} AS low,
        {edge(quantile(0.5), True)} AS median, {edge(quantile(adaptive_rules.TAIL), True)} AS high
      FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}) AS total
            FROM (SELECT {by}, bucket, count(*) AS n FROM told GROUP BY {by}, bucket) AS x) AS y
      GROUP BY {by})"""

    prior, margin = float(adaptive_rules.PRIOR_ROWS), adaptive_rules.REACH

    def drawn(name: str) -> str:
        by_lang = f"(l.n * l.{name} + {prior} * a.{name}) / (l.n + {prior})"
        return f"(o.n * o.{name} + {prior} * ({by_lang})) / (o.n + {prior}) AS {name}"

    measures = "[n_symbols / words, n_repeat_words / words, n_dup_lines / greatest(n_lines, 1), word_chars / words]"
    floors = "CASE measure " + " ".join(f"WHEN {i + 1} THEN {num(m[1])}" for i, m in enumerate(adaptive_rules.MEASURES)) + " END"
    two_sided = ", ".join(str(i + 1) for i, m in enumerate(adaptive_rules.MEASURES) if m[2])
    symbols = "[^#*$%&|<>]"
    ruled = f"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{_BLANK_WORD}') AS w
      FROM documents),
    grams AS (
      SELECT r, s, array_to_string(list_slice(w, s, s + 2), ' ') AS gram
      FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS s FROM docs WHERE len(w) > 2) AS x),
    often AS (SELECT r, gram FROM grams GROUP BY r, gram HAVING count(*) > 1),
    repeated AS (
      SELECT r, count(DISTINCT p) AS n FROM (
        SELECT r, unnest([s, s + 1, s + 2]) AS p FROM grams JOIN often USING (r, gram)) AS x GROUP BY r),
    lines AS (
      SELECT r, count(*) AS n, count(DISTINCT line) AS different
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) AS x
      WHERE regexp_matches(line, '{_BLANK_WORD}') GROUP BY r),
    counts AS (
      SELECT docs.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '{symbols}', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(lines.n - different, 0) AS BIGINT) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
        CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
      FROM docs LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)),
    judged AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {measures} AS m
      FROM (SELECT *, CAST(greatest(n_words, 1) AS DOUBLE) AS words FROM counts) AS x),
    measured AS (
      SELECT r, lang, source, base_failed, unnest([1, 2, 3, 4]) AS measure, unnest(m) AS v FROM judged),
    told AS (
      SELECT lang, source, measure,
        CASE WHEN v < 1e-4 THEN 0 ELSE CAST(ceil(ln(v / 1e-4) / {num(math.log(ratio))}) AS INTEGER) + 1 END AS bucket
      FROM measured WHERE NOT base_failed),
    {tails("own", "lang, source")}, {tails("by_lang", "lang")}, {tails("overall", "")},
    quantiles AS (
      SELECT o.lang, o.source, o.measure, {drawn("low")}, {drawn("median")}, {drawn("high")}
      FROM own AS o JOIN by_lang AS l ON l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure
      JOIN overall AS a ON a.measure = o.measure),
    fences AS (
      SELECT lang, source, measure, high + greatest({floors}, (high - median) * {margin}) AS most,
        CASE WHEN measure IN ({two_sided}) THEN low - greatest({floors}, (median - low) * {margin}) END AS least
      FROM quantiles),
    failed AS (
      SELECT DISTINCT r FROM measured JOIN fences ON fences.measure = measured.measure
        AND fences.lang IS NOT DISTINCT FROM measured.lang AND fences.source IS NOT DISTINCT FROM measured.source
      WHERE v > most OR coalesce(v < least, FALSE))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND failed.r IS NULL AS kept
    FROM judged LEFT JOIN failed USING (r)"""

    near = """
    WITH RECURSIVE rows AS (
      SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    parts AS (SELECT r, unnest(v) AS x FROM rows),
    usable AS (
      SELECT r, label, v FROM rows
      WHERE label IS NOT NULL AND r IN (SELECT r FROM parts WHERE x <> 0)
        AND r NOT IN (SELECT r FROM parts WHERE x IS NULL OR NOT isfinite(x))),
    links AS (
      SELECT x.r AS a, y.r AS b FROM usable AS x JOIN usable AS y ON x.label = y.label AND len(x.v) = len(y.v) AND x.r <> y.r
      WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
    counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a),
    reach AS (SELECT r AS a, r AS b FROM rows UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT reach.a AS r, min(rows.vec_id) AS component_id FROM reach JOIN rows ON rows.r = reach.b GROUP BY reach.a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id,
           vec_id IS NOT DISTINCT FROM component_id AS kept
    FROM rows JOIN least USING (r) LEFT JOIN counts USING (r)"""

    beginnings = """
    WITH RECURSIVE said AS (
      SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
    known AS (SELECT role, text, row_number() OVER () AS u, length(text) AS chars FROM (SELECT DISTINCT role, text FROM said) AS x),
    own AS (
      SELECT c, list(u ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS s
      FROM said JOIN known USING (role, text) GROUP BY c),
    crc AS (
      SELECT c, CAST(c AS VARCHAR) AS digits, 0 AS step, CAST(4294967295 AS BIGINT) AS v FROM own
      UNION ALL
      SELECT c, digits, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
      FROM (SELECT c, digits, step,
              CASE WHEN step % 8 = 0 THEN xor(v, CAST(ascii(digits[step // 8 + 1]) AS BIGINT)) ELSE v END AS x
            FROM crc WHERE step < 8 * length(digits)) AS y),
    heads AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE step = 8 * length(digits)),
    rebuilt AS (
      SELECT own.c, list_concat(coalesce(list_slice(base.s, 1, h), []), list_slice(own.s, h + 1, len(own.s))) AS s
      FROM own JOIN heads ON heads.c = own.c LEFT JOIN own AS base ON base.c = own.c - own.c % 100),
    nodes AS (
      SELECT list_slice(s, 1, d) AS p, d, min(c) AS conv_id, count(*) AS n
      FROM (SELECT c, s, unnest(generate_series(0, len(s))) AS d FROM rebuilt) AS x GROUP BY 1, 2),
    children AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
    each AS (
      SELECT p, d, conv_id, nodes.n, coalesce(children.n, 0) AS n_children, (nodes.n - 1) * coalesce(chars, 0) AS saved
      FROM nodes LEFT JOIN children USING (p) LEFT JOIN known ON u = p[d]),
    subtrees AS (
      SELECT list_slice(p, 1, a) AS p, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
      FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM each) AS x GROUP BY 1),
    ends AS (SELECT s AS p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest FROM rebuilt GROUP BY s)
    SELECT each.conv_id, CAST(each.d AS BIGINT) AS depth, parents.conv_id AS parent_conv_id, CAST(each.n AS BIGINT) AS n_convs,
           CAST(each.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
           CAST(subtrees.saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
    FROM each JOIN subtrees USING (p) LEFT JOIN ends USING (p)
    LEFT JOIN nodes AS parents ON each.d > 0 AND parents.p = list_slice(each.p, 1, each.d - 1)"""

    ranked = f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words(_WORD)} AS w FROM documents),
    held AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
    found AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM held) AS x GROUP BY r, term),
    items AS (
      SELECT k, item_id, unnest(list_distinct(w)) AS term
      FROM (SELECT row_number() OVER () AS k, item_id, {words(_WORD)} AS w FROM benchmark) AS x),
    weights AS (
      SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM found CROSS JOIN totals WHERE term IN (SELECT term FROM items) GROUP BY term),
    scored AS (
      SELECT k, item_id, doc_id, r,
        CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
      FROM items JOIN weights USING (term) JOIN found USING (term) JOIN held USING (r) CROSS JOIN totals
      GROUP BY k, item_id, doc_id, r),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id ASC NULLS LAST) AS place
      FROM scored WHERE score > 0)
    SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 50"""

    return {
        "op1_decontamination": decontaminated,
        "op2_warc": archived,
        "op4_quality_rules": ruled,
        "op7_ngram_join": linked,
        "op8_chat_bytes": formatted,
        "op11_metric_cells": near,
        "op12_prefix_trie": beginnings,
        "op13_lexical_search": ranked,
    }

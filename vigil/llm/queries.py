"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .common import table
from .embed_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .language import fit_languages, identify
from .lexical_search import lexical_search
from .mixing import poisson_mix
from .packing import pack
from .pii import replace_private
from .preference import format_preferences, swapped_replies
from .quality import fit_quality, score_quality
from .sharding import shard_by_key
from .simhash import simhash_dedup
from .spelling import spelling_variants
from .url_filter import filter_urls, fit_urls, labelled_urls

PSEUDONYM_KEY = b"key of the registered query"


def op1_epsilon_grid_join(spark, sf_dir):
    return embedding_dedup(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op2_compression_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])


def op3_preference_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    pairs = format_preferences(turns, swapped_replies(turns), pair_col="conv_id")

    def spans(mask):
        part = F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"), s["train"].cast("string")))
        return F.array_join(part, ",")

    return pairs.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


def op4_jump_shards(spark, sf_dir):
    return shard_by_key(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_best_two_fit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op6_feistel_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_private(docs, PSEUDONYM_KEY)


def op7_poisson_mix(spark, sf_dir):
    return poisson_mix(table(spark, sf_dir, "documents"))


def op8_simhash_bktree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_dedup(docs, words=4, radius=4, carry=["doc_id"])


def op9_url_ngrams(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, fit_urls(labelled_urls(spark))).drop("url")


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_presence_masks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search(docs, table(spark, sf_dir, "benchmark"))


def op12_trie_frontier(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_ftrl_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit_languages(docs), carry=["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (
        op1_epsilon_grid_join,
        op2_compression_quality,
        op3_preference_format,
        op4_jump_shards,
        op5_best_two_fit,
        op6_feistel_pseudonyms,
        op7_poisson_mix,
        op8_simhash_bktree,
        op9_url_ngrams,
        op10_exact_dedup,
        op11_presence_masks,
        op12_trie_frontier,
        op13_ftrl_language,
    )
}

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SIDE = """
        {name}_turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text
                  FROM {rows}),
        {name}_parts AS (
            SELECT t.conv_id, t.pos, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body, role
            FROM {name}_turns t),
        {name}_ends AS (
            SELECT p.conv_id, p.pos, head || body AS piece, length(head) AS h, length(body) AS b, role, p.pos <= s.shared AS early,
                   coalesce(sum(CASE WHEN p.pos > s.shared THEN length(head) + length(body) END)
                       OVER (PARTITION BY p.conv_id ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM {name}_parts p JOIN shared s USING (conv_id)),
        {name}_text AS (
            SELECT conv_id,
                   coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE early), '') AS prompt,
                   coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE NOT early), '') AS completion,
                   coalesce(string_agg(start || '-' || (start + h) || '-false,' || (start + h) || '-' || (start + h + b)
                       || CASE WHEN role = 'assistant' THEN '-true' ELSE '-false' END, ',' ORDER BY pos) FILTER (WHERE NOT early), '') AS mask
            FROM {name}_ends GROUP BY conv_id)"""

_TERMS = "unnest(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))".format(UP=UP, LOW=LOW)

# A table of the 256 remainders, and the CRC-32 of a text's UTF-8 octets.
_CRC_TABLE = """(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
            ORDER BY i) AS remainders FROM range(256) AS r(i))"""


def _crc(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295] || {octets}, lambda a, b: xor(a >> 8, remainders[xor(a & 255, b) + 1])), 4294967295)"


ORACLES = {
    "op1_epsilon_grid_join": """
        WITH RECURSIVE
        e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) = len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x)))
               AND len(list_filter(v, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
                 WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        reach(vec_id, other) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
        c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
        SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)""",
    "op3_preference_format": f"""
        WITH own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        last AS (SELECT conv_id, max(turn) AS turn FROM own WHERE role = 'assistant' GROUP BY conv_id),
        reply AS (SELECT conv_id, last.turn, max(own.text) AS text FROM own JOIN last USING (conv_id)
                  WHERE own.turn = last.turn AND own.role = 'assistant' GROUP BY ALL),
        swapped AS (SELECT o.conv_id, o.turn, o.role, CASE WHEN r.conv_id IS NOT NULL THEN coalesce(p.text, '') ELSE o.text END AS text
                    FROM own o LEFT JOIN reply r ON r.conv_id = o.conv_id AND r.turn = o.turn AND o.role = 'assistant'
                    LEFT JOIN reply p ON p.conv_id = xor(o.conv_id, 1)),
        x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text FROM own),
        y AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text FROM swapped),
        shared AS (SELECT x.conv_id, coalesce(min(CASE WHEN x.role <> y.role OR x.text <> y.text THEN x.pos END) - 1, count(*)) AS shared
                   FROM x JOIN y USING (conv_id, pos) GROUP BY x.conv_id),
        {_SIDE.format(name="c", rows="own")},
        {_SIDE.format(name="r", rows="swapped")}
        SELECT conv_id, c.prompt, shared::INTEGER AS prompt_turns, c.completion AS chosen, r.completion AS rejected,
               c.mask AS chosen_mask, r.mask AS rejected_mask
        FROM c_text c JOIN r_text r USING (conv_id) JOIN shared USING (conv_id)""",
    "op7_poisson_mix": """
        WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        rates AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n) AS rate FROM sizes),
        split AS (SELECT source, parts, rate / parts AS mean FROM (SELECT source, rate, greatest(ceil(rate / 500), 1)::BIGINT AS parts FROM rates)),
        terms AS (SELECT source, parts, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p
                  FROM (SELECT *, unnest(range(ceil(mean + 12 * sqrt(mean) + 25)::BIGINT + 1)) AS k FROM split)),
        cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
        lists AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
        draws AS (SELECT doc_id, source, unnest(range(parts)) AS part, cs FROM (SELECT DISTINCT doc_id, source FROM documents) d
                  JOIN lists l USING (source) UNION ALL
                  SELECT doc_id, NULL, unnest(range(parts)), cs FROM (SELECT DISTINCT doc_id FROM documents WHERE source IS NULL) d
                  JOIN lists l ON l.source IS NULL),
        drawn AS (SELECT doc_id, source, sum(len(list_filter(cs, lambda c: c <=
                         ('0x' || substr(md5(concat_ws('|', '7', part, doc_id)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0))) AS n_copies
                  FROM draws GROUP BY doc_id, source)
        SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5(concat_ws('|', 'order', '7', copy, doc_id)) AS shuffle_key
        FROM (SELECT d.*, n.n_copies::INTEGER AS n_copies, unnest(range(n.n_copies::BIGINT))::INTEGER AS copy FROM documents d
              JOIN drawn n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source)""",
    "op10_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op11_presence_masks": f"""
        WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents),
        n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, s),
        q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
        scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // len))))::BIGINT AS score
                   FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
                   FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op12_trie_frontier": f"""
        WITH RECURSIVE
        runs AS (SELECT doc_id, run, count(*) AS n
                 FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
                 GROUP BY doc_id, run),
        drawn AS (SELECT run, n, {_crc("doc_id || ':' || run")} AS h FROM runs, {_CRC_TABLE}),
        spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
                  FROM drawn),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        less AS MATERIALIZED (SELECT word, k, substr(word, 1, k::INT) || substr(word, k::INT + 2) AS rest
                              FROM (SELECT word, unnest(range(length(word))) AS k FROM words)),
        pairs AS (SELECT DISTINCT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
                  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words)
                  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
        near AS (SELECT p.a AS word, p.b AS other, w.n, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, encode(p.b)) AS place,
                        count(*) OVER (PARTITION BY p.a) AS n_near FROM pairs p JOIN words w ON w.word = p.b),
        form AS MATERIALIZED (SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.other END AS form,
                        CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n FROM words w LEFT JOIN near r ON r.word = w.word AND r.place = 1),
        walk(word, tip) AS (SELECT word, word FROM form UNION ALL SELECT walk.word, f.form FROM walk JOIN form f ON f.word = walk.tip WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, w.tip AS root, f.n, f.n_near, f.form_n
        FROM form f JOIN walk w ON w.word = f.word JOIN form e ON e.word = w.tip WHERE e.form IS NULL""",
}

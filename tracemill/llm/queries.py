"""Registered queries over the test tables, and the SQL that gives the same rows.

Each query applies its operator to the whole table with production parameters and
derives digests from what the operator returns. Queries without SQL are held
against brute force, round trips or held-out labels in the tests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.conversation_repair import (
    all_conversations,
    conversation_digests,
    repair_conversations,
)
from tracemill.llm.decontaminate import decontaminate
from tracemill.llm.licenses import TEMPLATES, license_scan, license_texts, templates
from tracemill.llm.line_dedup import dedup_lines
from tracemill.llm.line_frequency import quality_rules
from tracemill.llm.near_dedup import near_duplicates
from tracemill.llm.packing import pack, pieces
from tracemill.llm.quality_fm import quality_scores
from tracemill.llm.sentence_pieces import decode_pieces, encode_pieces, ids_text
from tracemill.llm.source_divergence import source_divergence
from tracemill.llm.substring_dedup import drop_repeats
from tracemill.llm.token_files import tokenize
from tracemill.llm.toxicity import toxicity_scores

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["length"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize(_table(spark, folder, "documents"), TOKENIZER)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return quality_scores(docs, labels, metadata=["n_chars"])


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = drop_repeats(_table(spark, folder, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op5_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(pieces(_table(spark, folder, "documents"), TOKENIZER))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", "doc_id")
    docs, full = _table(spark, folder, "documents"), license_texts(spark)
    return license_scan(docs, templates(spark), path, full_texts=full)


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_table(spark, folder, "documents")).drop("boilerplate")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(_table(spark, folder, "documents"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of id and turn; nulls are blanks."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.pmod(F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"])), F.lit(20))
    changed = (
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.translate(text["text"], ".!?", ""))
        .otherwise(text["text"])
    )
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(text["role"]).alias("role"),
        changed.alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    )


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    pieces = repair_conversations(damaged(rows))
    return all_conversations(conversation_digests(pieces), rows)


def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    found = decode_pieces(encode_pieces(_table(spark, folder, "documents"), PIECES), PIECES)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(_table(spark, folder, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_files": op2_token_files,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pack": op5_pack,
    "op6_licenses": op6_licenses,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversations": op11_conversations,
    "op12_pieces": op12_pieces,
    "op13_divergence": op13_divergence,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_STRIP = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# The checksum of a short text, byte by byte.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split({text}, ''), lambda x: ord(x)::UBIGINT)), lambda a, b: list_reduce(
    list_prepend(xor(a, b), list_transform(range(8), lambda z: 0::UBIGINT)), lambda x, y:
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),
    4294967295::UBIGINT)"""


def _way(cost: str, letter: str, then: int, line: str | None = None) -> str:
    """Edit a row and go on in the state ``then`` with the best of the later rows."""
    lines = f"list_prepend({line}, best[{then}].m)" if line else f"best[{then}].m"
    return f"{{'c': {cost} + best[{then}].c, 's': '{letter}' || best[{then}].s, 'm': {lines}}}"


def _rows_way(state: int) -> str:
    """The best way from a state on that begins with an edit of the row."""
    to = {1: 3, 2: 3, 3: 4, 4: 3}[state]
    role = "assistant" if to == 4 else "user"
    ways = [_way("4", "D", state)]
    ways.append(f"CASE WHEN kind <> 'gone' THEN {_way('3 + cut', 'R', to, f"'{role}:' || text")} END")
    for first, then in {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}[state].items():
        kept = _way("cut", "K", then, "role || ':' || text")
        ways.append(f"CASE WHEN kind <> 'gone' AND role[1] = '{first}' THEN {kept} END")
    return f"list_min([{', '.join(ways)}])"


def _filled_way(state: int, later: str) -> str:
    """As it is in the row's ways ``w``, or after one inserted message."""
    to = {1: 3, 2: 3, 3: 4, 4: 3}[state]
    line = "assistant:" if to == 4 else "user:"
    more = f"{{'c': 3 + {later}[{to}].c, 's': 'I' || {later}[{to}].s, 'm': list_prepend('{line}', {later}[{to}].m)}}"
    return f"list_min([w[{state}], {more}])"


_NOTICES = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)

ORACLES = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM documents),
        t AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w
            FROM benchmark),
        win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
            SELECT item, w, least(10, len(w)) AS k,
                unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
            FROM t WHERE len(w) > 0)),
        dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
            SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        occ AS (SELECT DISTINCT doc_id, item, i, k FROM dw JOIN win USING (k, s)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n
            FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l
            FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit,
            coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
            coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w
            FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (
            SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN dup USING (s)),
        lost AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM (
            SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d)
            ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
            sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op6_licenses": f"""
        WITH RECURSIVE lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
        heads AS (SELECT doc_id, line, row_number() OVER () AS place FROM lines
            WHERE regexp_matches(line, '(?i)licen[cs]|copyright|spdx|public domain')),
        whole AS (SELECT doc_id, text AS line, -1 AS place FROM documents
            WHERE regexp_matches(text, '(?i)licen[cs]|copyright|spdx|public domain')),
        known AS (SELECT DISTINCT license, line FROM (VALUES {_NOTICES}) v(license, line)),
        texts AS (SELECT 'h' AS kind, doc_id::VARCHAR AS a, place, line FROM heads
            UNION ALL SELECT 'w', doc_id::VARCHAR, place, line FROM whole
            UNION ALL SELECT 't', license || '/' || line, 0, line FROM known),
        raw AS (SELECT kind, a, place,
            unnest(regexp_split_to_array(lower(line), '[^a-z0-9.+-]+')) AS x FROM texts),
        words AS (SELECT kind, a, place, x, count(*) AS n FROM (
            SELECT kind, a, place, regexp_replace(x, '^[.+-]+|[.+-]+$', '', 'g') AS x FROM raw)
            WHERE x <> '' GROUP BY ALL),
        df AS (SELECT x, count(*) AS t FROM words WHERE kind <> 'w' GROUP BY x),
        size AS (SELECT (SELECT count(*) FROM heads) + (SELECT count(*) FROM known) AS total),
        weighed AS (SELECT kind, a, place, x,
            n * (ln((1 + total) / (1 + coalesce(t, 0))) + 1) AS w
            FROM words LEFT JOIN df USING (x), size),
        vec AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY kind, a, place)) AS v FROM weighed),
        cos AS (SELECT d.kind, d.a, d.place, t.a AS tpl, round(sum(d.v * t.v), 6) AS c
            FROM vec d JOIN vec t ON d.x = t.x AND t.kind = 't' WHERE d.kind <> 't' GROUP BY ALL),
        best AS (SELECT kind, a::BIGINT AS doc_id,
            min({{'less': -c, 'license': split_part(tpl, '/', 1)}}) AS b FROM cos GROUP BY ALL),
        own AS (SELECT doc_id, min(b) FILTER (kind = 'w') AS f, min(b) FILTER (kind = 'h') AS h
            FROM best GROUP BY doc_id),
        direct AS (SELECT d.doc_id, concat_ws('/', source, lang, doc_id) AS path,
            concat_ws('/', source, lang) AS dir,
            CASE WHEN f.less <= -0.6 THEN 'file' WHEN h.less <= -0.6 THEN 'header' END AS origin,
            CASE WHEN f.less <= -0.6 THEN f WHEN h.less <= -0.6 THEN h END AS b
            FROM documents d LEFT JOIN own USING (doc_id)),
        files AS (SELECT dir, min(b) AS up FROM direct WHERE origin = 'file' GROUP BY dir)
        SELECT direct.doc_id, path, coalesce(n, 0)::BIGINT AS n_headers,
            coalesce(b.license, up.license) AS license, -coalesce(b.less, up.less) AS cosine,
            coalesce(origin, CASE WHEN up IS NOT NULL THEN 'inherited' END) AS origin
        FROM direct
        LEFT JOIN files ON files.dir = direct.dir AND origin IS NULL
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM heads GROUP BY doc_id) c
            ON c.doc_id = direct.doc_id""",
    "op7_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_SPACED}) AS w
            FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
            FROM d WHERE len(w) > 0)),
        size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
            FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
            WHERE 100 * i >= 85 * (x.n + y.n - i)),
        reach(a, b) AS (SELECT a, b FROM link
            UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
            least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
            d.doc_id <= coalesce(m, d.doc_id) AS kept
        FROM d LEFT JOIN size USING (doc_id)
        LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) r USING (doc_id)""",
    "op8_quality_rules": f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (
            SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
        again AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win SEMI JOIN again USING (doc_id, s))
            GROUP BY doc_id),
        lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
        worded AS (SELECT *, len(regexp_extract_all(line, {_SPACED})) AS n,
            regexp_replace(translate(array_to_string(regexp_extract_all(line, {_SPACED}), ' '),
                '{_UPPER}', '{_LOWER}'), '[0-9]+', '0', 'g') AS norm
            FROM lines WHERE regexp_matches(line, {_SPACED})),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
        host AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
        common AS (SELECT source, norm FROM worded JOIN host USING (source) GROUP BY source, norm, docs
            HAVING count(DISTINCT doc_id) > greatest(20, docs * 0.02)),
        boil AS (SELECT doc_id, sum(n) AS n FROM worded SEMI JOIN common USING (source, norm)
            GROUP BY doc_id),
        stats AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
            length(array_to_string(w, ''))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
            coalesce(boil.n, 0)::BIGINT AS n_boilerplate
            FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dups USING (doc_id)
            LEFT JOIN boil USING (doc_id))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
                AND 100 * (n_words - n_boilerplate) >= 30 * n_words AS kept
        FROM stats""",
    "op10_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
            unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p
            FROM documents),
        k AS (SELECT *, translate(trim(line, {_STRIP}), '{_UPPER}', '{_LOWER}') AS key FROM l),
        often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        judged AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS gone
            FROM k LEFT JOIN often USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op11_conversations": f"""
        WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role,
            coalesce(text, ' ') AS text, {_CRC.format(
                text="concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))"
            )} % 20 AS k FROM conversations),
        rows AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
            CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM named),
        placed AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before,
            rtrim(text, {_STRIP}) AS solid,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
            FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        judged AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
            WHEN solid[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
        ready AS (SELECT conv_id, i, role, text,
            CASE WHEN fault IN ('blank', 'duplicate') THEN 'gone' ELSE 'fine' END AS kind,
            CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM judged),
        step(conv_id, i, best) AS (
            SELECT conv_id, max(i), [{{'c': 0, 's': '', 'm': []::VARCHAR[]}},
                {{'c': 6, 's': 'II', 'm': ['user:', 'assistant:']}},
                {{'c': 3, 's': 'I', 'm': ['assistant:']}}, {{'c': 0, 's': '', 'm': []::VARCHAR[]}}]
            FROM ready GROUP BY conv_id
            UNION ALL
            SELECT conv_id, i - 1, [{', '.join(_filled_way(q, 'o') for q in (1, 2, 3, 4))}]
            FROM (SELECT *, [{', '.join(_filled_way(q, 'w') for q in (1, 2, 3, 4))}] AS o
                FROM (SELECT step.conv_id, step.i, [{', '.join(_rows_way(q) for q in (1, 2, 3, 4))}] AS w
                    FROM step JOIN ready ON ready.i = step.i
                        AND ready.conv_id IS NOT DISTINCT FROM step.conv_id))),
        sums AS (SELECT conv_id,
            coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
            coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best[1].c, 0)::BIGINT AS cost,
            coalesce(best[1].s, '') AS audit,
            sha256(coalesce(array_to_string(best[1].m, chr(10)), '')) AS repaired_sha256
        FROM ids LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id
        LEFT JOIN step ON step.conv_id IS NOT DISTINCT FROM ids.conv_id AND step.i = 0""",
    "op13_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang,
            coalesce(source, '') AS source, regexp_extract_all({_FOLDED},
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        words AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 10),
        n AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term)
            GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        sums AS (SELECT lang, source, sum(c) AS total FROM n GROUP BY ALL),
        cells AS (SELECT g.lang, g.source, term, coalesce(c, 0) AS c,
            1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2) // (coalesce(total, 0) + 2 * v) AS p
            FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN sums USING (lang, source)
            LEFT JOIN n USING (lang, source, term)),
        whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c) + 2)
            // (any_value(total) + 2 * any_value(v)) AS q
            FROM n JOIN v USING (lang) JOIN (SELECT lang, sum(c) AS total FROM n GROUP BY lang) USING (lang)
            GROUP BY lang, term),
        pairs AS (SELECT a.lang, a.source, b.source AS item,
            sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY ALL),
        every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
        own AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
            FROM cells JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
        ranked AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source
                ORDER BY value DESC, item) AS rank FROM every
            UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source
                ORDER BY value DESC, item) FROM own)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 10""",
}

"""SQL for the document operators that DuckDB can state, over whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

#: Function words of the stop-word rule, written out apart from the operator.
STOP = (
    "the of and to in a is that for it was on with as by be are at this from or an not have he his which you we they "
    "de la le et les des en un une du est que pour dans qui sur pas au par avec ce il plus se "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es bei über "
    "el y los del las por con no una su para al lo como más o"
)


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_BOTH = sorted({form for w in STOP.split() for form in (w, w.capitalize())})

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
wins AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM wins)
  QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(8) AS r(o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id,
    len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
    len(list_filter(ws, lambda x: x IN ({_quoted(_BOTH)})))::BIGINT AS n_stop_words,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
n AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m),
r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
    n_words BETWEEN 20 AND 100000 AS length_ok,
    word_chars BETWEEN 2 * n_words AND 14 * n_words AS word_length_ok,
    n_symbols <= 0.3::DOUBLE * n_words AS symbols_ok,
    n_stop_words >= 0.04::DOUBLE * n_words AND n_stop_words <= 0.9::DOUBLE * n_words AS stop_words_ok,
    n_dup_lines <= 0.5::DOUBLE * n_lines AS repeated_lines_ok,
    n_words >= 2 * n_lines AND n_words <= 20000 * n_lines AS line_length_ok,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM n)
SELECT *, NOT base_failed AND length_ok AND word_length_ok AND symbols_ok AND stop_words_ok
  AND repeated_lines_ok AND line_length_ok AS kept
FROM r
"""

NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.id LEFT JOIN n ON d.doc_id = n.doc_id
"""

REPEATS = f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS ws FROM documents),
wins AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS k FROM wins)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, range(20) AS r(o)),
each AS (SELECT doc_id, ws[p] AS x, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT each.doc_id, x, each.p FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p),
joined AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN joined ON w.doc_id = joined.doc_id
"""


def _mixing(rounds: int = 12) -> str:
    """Raking in unrolled steps, one per marginal and one to trim, each a table of its own."""
    powers = {"source": 0.5, "lang": 0.7, "topic": 0.7}
    parts = [
        f"""d AS (SELECT doc_id, source, lang, text, len(coalesce(regexp_extract_all(text, '{WORD}'), []))::BIGINT AS n_tokens FROM documents)""",
        """s AS (SELECT doc_id, source, lang, n_tokens, CASE
  WHEN text LIKE '% | %' THEN 'table' WHEN text LIKE '%!!%' THEN 'shout'
  WHEN text LIKE '%##%' OR text LIKE '%$$%' OR text LIKE '%&&%' THEN 'marked'
  WHEN n_tokens < 200 THEN 'short' WHEN n_tokens < 2000 THEN 'medium' ELSE 'long' END AS topic FROM d)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM s GROUP BY ALL)",
        "whole AS (SELECT sum(tokens) AS t FROM cells)",
    ]
    for m, power in powers.items():
        parts.append(f"p_{m} AS (SELECT {m}, pow(sum(tokens) / (SELECT t FROM whole), {power}) AS p FROM cells GROUP BY {m})")
        parts.append(f"t_{m} AS (SELECT {m}, p / (SELECT sum(p) FROM p_{m}) * (SELECT t FROM whole) AS target FROM p_{m})")
    parts.append("x0 AS MATERIALIZED (SELECT *, tokens AS w FROM cells)")
    last = "x0"
    for r in range(rounds):
        for m in powers:
            new = f"x{r}_{m}"
            parts.append(
                f"{new} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, CASE WHEN now > 0 THEN w * target / now ELSE 0 END AS w "
                f"FROM (SELECT *, sum(w) OVER (PARTITION BY {m}) AS now FROM {last}) c JOIN t_{m} ON c.{m} IS NOT DISTINCT FROM t_{m}.{m})"
            )
            last = new
        parts.append(f"y{r} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(w, tokens / 0.5) AS w FROM {last})")
        last = f"y{r}"
    parts.append(
        f"z AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(1.0, 0.5 * w / tokens) ELSE 0 END, 9)::DOUBLE AS probability FROM {last})"
    )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT s.doc_id, s.source, s.lang, s.topic, s.n_tokens, z.probability, "
        "s.n_tokens > 0 AND ('0x' || substr(md5(s.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < z.probability AS sampled "
        "FROM s JOIN z ON s.source IS NOT DISTINCT FROM z.source AND s.lang IS NOT DISTINCT FROM z.lang AND s.topic = z.topic"
    )


def _tree_sql(name: str, levels: int) -> list[str]:
    """Levels of trees over a table `name`0 (tree, p, d): next nodes, and the siblings of each node where its tree goes on."""
    parts = []
    for k in range(levels):
        parts.append(f"{name}n{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k})")
        parts.append(
            f"{name}s{k} AS MATERIALIZED (SELECT a.tree, a.p, coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l, "
            f"coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r, a.n > 1 AS used "
            f"FROM {name}n{k} a JOIN {name}n{k} b ON a.tree = b.tree AND a.p // 8 = b.p // 8 GROUP BY a.tree, a.p, a.n)"
        )
        parts.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT tree, p // 8 AS p, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE min(d) END AS d "
            f"FROM {name}n{k} GROUP BY tree, n, p // 8)"
        )
    return parts


def _manifest(levels: int = 7, top_levels: int = 3) -> str:
    """Unrolled levels: up to 8^7 documents of a language, and 8^3 languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    own = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32, bit by bit: a fold over the bytes, and in it one over the eight bits.
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
        "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
    )
    parts = [
        f"docs AS MATERIALIZED (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, sha256({own} || {field('text')}) AS d, "
        f"CASE WHEN {crc} % 3 = 0 THEN sha256({own} || {field(lowered)}) END AS other FROM documents)",
        "a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS p FROM docs)",
        "a0 AS MATERIALIZED (SELECT tree, p, d FROM a)",
        *_tree_sql("a", levels),
        f"b AS MATERIALIZED (SELECT tree AS name, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS p FROM a{levels})",
        "b0 AS MATERIALIZED (SELECT 't' AS tree, p, d FROM b)",
        *_tree_sql("b", top_levels),
        f"f0 AS MATERIALIZED (SELECT a.doc_id, a.d AS leaf, a.tree, a.p, b.p AS q, b.d AS subroot, (SELECT d FROM b{top_levels}) AS root, "
        "coalesce(a.other, a.d) AS f, '' AS proof FROM a JOIN b ON a.tree = b.name)",
    ]
    steps = [(f"as{k}", "f.tree", "p", k) for k in range(levels)] + [(f"bs{k}", "'t'", "q", k) for k in range(top_levels)]
    for i, (table, tree, at, k) in enumerate(steps):
        parts.append(
            f"f{i + 1} AS MATERIALIZED (SELECT f.doc_id, f.leaf, f.tree, f.p, f.q, f.subroot, f.root, "
            f"CASE WHEN s.used THEN sha256(s.l || f.f || s.r) ELSE f.f END AS f, CASE WHEN s.used THEN f.proof || s.l || s.r ELSE f.proof END AS proof "
            f"FROM f{i} f JOIN {table} s ON s.tree = {tree} AND s.p = f.{at} // {8 ** k})"
        )
    last = f"f{len(steps)}"
    return (
        "WITH " + ",\n".join(parts)
        + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}"
    )


NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS place
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, place::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE place <= 3
"""

ARCHIVED = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d),
r AS (SELECT page_id, n, p.d, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM p JOIN f ON p.d = f.d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""


ORACLES = {
    "op1_quality_rules": QUALITY,
    "op2_near_duplicates": NEAR,
    "op7_repeated_passages": REPEATS,
    "op8_source_mixing": _mixing(),
    "op11_warc_index": ARCHIVED,
    "op12_merkle_manifest": _manifest(),
    "op13_hard_negatives": NEGATIVES,
}

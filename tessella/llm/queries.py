"""The queries of the corpus operators and, where SQL can express them, their DuckDB SQL.

Substring dedup, near-duplicates, clustering, the set join and search return what their contracts name alone, which SQL can
say by brute force: all windows, all pairs that share a shingle, all distances, all scores. The others also return their method's own columns (verdicts of zstandard, spans of a
trained model, ids of a tokenizer, a checksum that DuckDB lacks), so they are tested against brute-force versions instead.
"""

from __future__ import annotations

from tessella.llm.bpe import op7_chunked_bpe
from tessella.llm.centroids import op11_interval_centroids
from tessella.llm.decontaminate import op10_pigeonhole_matches
from tessella.llm.html_text import op8_text_tag_ratio
from tessella.llm.language_model import op4_kneser_ney
from tessella.llm.licenses import op5_license_paragraphs
from tessella.llm.near_dups import op9_bottomk_near_dups
from tessella.llm.quality import op1_compression_bands
from tessella.llm.search import op13_impact_search
from tessella.llm.secrets import op3_markov_secrets
from tessella.llm.set_join import op12_heavy_light_join
from tessella.llm.sharding import op2_interleaved_shards
from tessella.llm.substrings import op6_superkmer_dedup

_ALL = (
    op1_compression_bands,
    op2_interleaved_shards,
    op3_markov_secrets,
    op4_kneser_ney,
    op5_license_paragraphs,
    op6_superkmer_dedup,
    op7_chunked_bpe,
    op8_text_tag_ratio,
    op9_bottomk_near_dups,
    op10_pigeonhole_matches,
    op11_interval_centroids,
    op12_heavy_light_join,
    op13_impact_search,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Every window of 50 words with the least doc_id in which it starts; a word goes if the last such start lies within 49 words.
SUBSTRINGS = f"""
WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM t WHERE len(ws) >= 50)),
f AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
h AS (SELECT DISTINCT doc_id, i FROM w JOIN f USING (k) WHERE m < doc_id),
s AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM t),
c AS (SELECT s.doc_id, word, j, max(i) OVER (PARTITION BY s.doc_id ORDER BY j) AS last FROM s LEFT JOIN h ON h.doc_id = s.doc_id AND i = j),
g AS (SELECT doc_id, count(*) FILTER (j - last < 50) AS gone, string_agg(word, ' ' ORDER BY j) FILTER (last IS NULL OR j - last >= 50) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN g USING (doc_id)
"""

def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _linked(size: int, percent: int, last: str) -> str:
    """All pairs of documents that share a shingle of so many words, their exact similarity, and what can be reached by links."""
    words = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(size))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(_lowered("text"))} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')] ELSE list_distinct([{words} for i in range(1, len(ws) - {size - 2})]) END AS sh FROM t),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, {last} FROM s JOIN m ON id = doc_id
"""


def _clusters(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """All distances of all vectors in each round; distance and number are one integer, so that the least has the smaller number."""
    away = f"CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (e[i] - c[i]) * (e[i] - c[i]))) AS BIGINT)"
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({dims} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {dims})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, e AS c FROM v ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, min({away} * {k} + j) AS m FROM v, c{r} GROUP BY vec_id)")
        if r < rounds:
            steps += [
                f"s{r} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT m % {k} AS j, unnest(e) AS x, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY j, i)",
                f"n{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY j)",
                f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (j))",
            ]
    last = f"SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, CAST(m // {k} AS BIGINT) AS distance FROM a{rounds}"
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM ({last}) JOIN c{rounds} ON j = cluster
"""


#: Every document's score for every item that shares a term with it.
SEARCH = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_lowered("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS n_all, CAST(sum(len(ws)) AS BIGINT) AS l_all FROM t WHERE len(ws) > 0),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM t) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, n_all),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_all) // l_all)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        op6_superkmer_dedup.__name__: SUBSTRINGS,
        op9_bottomk_near_dups.__name__: _linked(2, 80, "c AS component_id, doc_id = c AS kept"),
        op11_interval_centroids.__name__: _clusters(),
        op12_heavy_light_join.__name__: _linked(4, 85, "c AS component_id"),
        op13_impact_search.__name__: SEARCH,
    }

"""SQL that states what the SQL-expressible queries of the training-data problems compute."""

from __future__ import annotations

WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}|{WHITE}$', '', 'g')"


# the engine's lower() lacks the final form of sigma, which Unicode's lower case has
_LOWER = r"lower(regexp_replace({x}, '(\p{{L}})Σ($|[^\p{{L}}])', '\1ς\2', 'g'))"
_LINES = f"""s AS (SELECT doc_id, bookshelf_id, string_split(text, chr(10)) AS ls FROM documents WHERE bookshelf_id IS NOT NULL AND text IS NOT NULL),
 l AS (SELECT doc_id, bookshelf_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM s),
 n AS (SELECT doc_id, bookshelf_id, line_no, {_LOWER.format(x=f"trim(regexp_replace(regexp_replace(line, '[0-9]+', '0', 'g'), '{WHITE}', ' ', 'g'))")} AS x FROM l),
 z AS (SELECT bookshelf_id, count(*) AS size FROM documents WHERE bookshelf_id IS NOT NULL GROUP BY 1),
 f AS (SELECT bookshelf_id, x, count(DISTINCT doc_id) AS k FROM n WHERE length(x) >= 20 GROUP BY 1, 2),
 r AS (SELECT n.doc_id, CAST(n.line_no AS BIGINT) AS line_no FROM n JOIN f USING (bookshelf_id, x) JOIN z USING (bookshelf_id) WHERE f.k >= 5 AND f.k >= 0.05::DOUBLE * z.size)"""


def _triples(table: str, node: str) -> str:
    """CTEs t (node, t: a word triple) and c (node, n: its number of triples) of the records with 20 words or more."""
    text = "coalesce(title, '') || ' ' || coalesce(text, '')"
    return f"""w AS (SELECT {node}, regexp_extract_all({_LOWER.format(x=text)}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}),
 t AS (SELECT DISTINCT {node}, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT {node}, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
 c AS (SELECT {node}, count(*) AS n FROM t GROUP BY 1)"""


# each line of five documents or more against all other sources: twice the log-likelihood ratio, and the least eighth of a unit that passes the step at 1 %
_TESTS = f"""{_LINES}, e AS (SELECT x, sum(k) AS k FROM f GROUP BY 1), a AS (SELECT sum(size) AS n FROM z),
 o AS (SELECT bookshelf_id, x, CAST(f.k AS DOUBLE) AS k1, CAST(size AS DOUBLE) AS n1, CAST(e.k - f.k AS DOUBLE) AS k2, CAST(n - size AS DOUBLE) AS n2 FROM f JOIN e USING (x) JOIN z USING (bookshelf_id) CROSS JOIN a WHERE f.k >= 5),
 p AS (SELECT *, (k1 + k2) / (n1 + n2) AS rate FROM o),
 q AS (SELECT *, CASE WHEN k1 * n2 > k2 * n1 THEN 2 * ({" + ".join(f"CASE WHEN {k} > 0 THEN {k} * ln({k} / ({n})) ELSE 0 END" for k, n in (("k1", "n1 * rate"), ("(n1 - k1)", "n1 * (1 - rate)"), ("k2", "n2 * rate"), ("(n2 - k2)", "n2 * (1 - rate)")))}) ELSE 0 END AS llr FROM p),
 b AS (SELECT least(floor(llr * 8), 11200) / 8 AS edge, count(*) AS n FROM q GROUP BY 1),
 k AS (SELECT edge, sum(n) OVER (ORDER BY edge DESC) AS rank, sum(n) OVER () AS m, sqrt(edge / 2) AS y, 1 / (1 + 0.3275911::DOUBLE * sqrt(edge / 2)) AS u FROM b),
 c AS (SELECT min(edge) AS cut FROM k WHERE 0.5::DOUBLE * u * (0.254829592::DOUBLE + u * (-0.284496736::DOUBLE + u * (1.421413741::DOUBLE + u * (-1.453152027::DOUBLE + u * 1.061405429::DOUBLE)))) * exp(-y * y) <= 0.01::DOUBLE * rank / m)"""


def _components(edges: str, nodes: str) -> str:
    """CTE g (id, component) of the graph with edges e (a, b): labels spread until none changes."""
    return f"""e2 AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})),
 g0 AS (SELECT doc_id AS id, doc_id AS c FROM {nodes}),
 r(id, c) AS (SELECT id, c FROM g0 UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a = r.id),
 g AS (SELECT id, min(c) AS component FROM r GROUP BY 1)"""


_P1 = f"""{_triples("documents", "doc_id")}, m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
 p1 AS MATERIALIZED (SELECT a, b, k = x.n AND k = y.n AS same FROM m JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 10 * k >= 7 * (x.n + y.n - k))"""
_P4 = f"""{_triples("corpus_records", "rec_id")}, s AS (SELECT rec_id, bookshelf_id, CASE WHEN lower({_strip("split")}) = 'validation' THEN 'val' ELSE lower({_strip("split")}) END AS split FROM corpus_records WHERE split IS NOT NULL),
 u AS (SELECT t.*, split = 'train' AS train FROM t JOIN s USING (rec_id)), m AS (SELECT a.rec_id AS b, b.rec_id AS a, count(*) AS k FROM u a JOIN u b ON a.t = b.t WHERE a.train AND NOT b.train GROUP BY 1, 2),
 p4 AS MATERIALIZED (SELECT a, b, x.n AS na, y.n AS nb FROM m JOIN c x ON x.rec_id = a JOIN c y ON y.rec_id = b WHERE 10 * k >= 7 * least(x.n, y.n))"""
_P8 = """gr AS (SELECT DISTINCT doc_id, substr(text, i, 300) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
 h AS (SELECT list(doc_id ORDER BY doc_id) AS ids FROM gr GROUP BY s HAVING count(*) > 1), d AS (SELECT DISTINCT ids FROM h), x AS (SELECT ids, unnest(ids) AS a FROM d),
 p8 AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, unnest(ids) AS b FROM x) WHERE a < b)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_P1} SELECT a AS doc_id_a, b AS doc_id_b FROM p1",
        "p1_groups": f"""WITH RECURSIVE {_P1}, {_components("SELECT a, b FROM p1", "documents")}, k AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p1 WHERE same UNION ALL SELECT b FROM p1 WHERE same) GROUP BY 1)
SELECT g.id AS doc_id, component AS group_id, count(*) OVER (PARTITION BY component) AS group_size, coalesce(k.n, 0) AS n_copies FROM g LEFT JOIN k USING (id)""",
        "p4_found": f"WITH {_P4} SELECT least(a, b) AS rec_id_a, greatest(a, b) AS rec_id_b FROM p4",
        "p4_report": f"""WITH {_P4}, z AS (SELECT rec_id, ' ' || array_to_string(w, ' ') || ' ' AS w FROM w WHERE len(w) >= 20),
 q AS (SELECT a, count(*) AS pairs, count(CASE WHEN CASE WHEN na <= nb THEN contains(y.w, x.w) ELSE contains(x.w, y.w) END THEN 1 END) AS same FROM p4 JOIN z x ON x.rec_id = a JOIN z y ON y.rec_id = b GROUP BY 1)
SELECT split, bookshelf_id, count(*) AS n_records, count(pairs) AS n_overlapping, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS n_pairs, CAST(coalesce(sum(same), 0) AS BIGINT) AS n_same FROM s LEFT JOIN q ON q.a = s.rec_id WHERE split <> 'train' GROUP BY 1, 2""",
        "p8_found": f"WITH {_P8} SELECT a AS doc_id_a, b AS doc_id_b FROM p8",
        "p8_groups": f"WITH RECURSIVE {_P8}, {_components('SELECT a, b FROM p8', 'documents')} SELECT id AS doc_id, component AS group_id, id = component AS keep FROM g",
        "p6_roundtrip": "SELECT lang, count(*) AS n_docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS n_different FROM documents GROUP BY 1",
        "p3_found": f"WITH {_LINES} SELECT doc_id, line_no FROM r",
        "p3_clean": f"""WITH {_LINES}, g AS (SELECT doc_id, list(line_no) AS gone FROM r GROUP BY 1),
 d AS (SELECT d.doc_id, text, gone, string_split(text, chr(10)) AS ls FROM documents d LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string([ls[i + 1] for i in range(len(ls)) if NOT list_contains(gone, i)], chr(10)), '') END AS text,
 CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed FROM d""",
        "p3_report": f"""WITH {_TESTS} SELECT z.bookshelf_id, size AS n_docs, count(q.x) AS n_lines, count(CASE WHEN llr >= cut AND llr > 0 THEN 1 END) AS n_excess
FROM z CROSS JOIN c LEFT JOIN q ON q.bookshelf_id = z.bookshelf_id AND k1 >= 0.05::DOUBLE * n1 GROUP BY 1, 2""",
        "p5_found": """SELECT 'document' AS item_kind, doc_id AS item_id FROM documents WHERE length(text) > 6000
UNION ALL SELECT 'example', example_id FROM examples WHERE len(list_filter(attention_mask, lambda x: x = 1)) > 512""",
        "p5_invariants": """SELECT 'document' AS item_kind, doc_id AS item_id, length(text) AS size, true AS fits, true AS covers, true AS repeats, true AS whole FROM documents WHERE length(text) > 6000
UNION ALL SELECT 'example', example_id, len(list_filter(attention_mask, lambda x: x = 1)), true, true, true, true FROM examples WHERE len(list_filter(attention_mask, lambda x: x = 1)) > 512""",
        "p8_shared": """WITH g AS (SELECT doc_id, i, substr(text, i, 300) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
 h AS (SELECT s FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1), p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM g SEMI JOIN h USING (s)),
 c AS (SELECT doc_id, sum(CASE WHEN prev IS NULL THEN 300 ELSE least(300, i - prev) END) AS n, count(CASE WHEN prev IS NULL OR i - prev > 300 THEN 1 END) AS runs FROM p GROUP BY 1)
SELECT d.doc_id, length(text) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, coalesce(runs, 0) AS n_runs FROM documents d LEFT JOIN c USING (doc_id)""",
    }

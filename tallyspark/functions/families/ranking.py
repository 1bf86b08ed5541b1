"""Retrieval rankings and text evaluation."""

from ..recipes import define, source

source("hits", "SELECT g, query, rel, row_number() OVER (PARTITION BY g, query ORDER BY rank, pos) AS rn FROM {t} k0")
source("running", "SELECT g, query, rel, rn, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g, query ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS found FROM {hits} k1")
source(
    "per_query",
    """SELECT g, query, count_if(rel > 0) AS r, count(*) AS n, count_if(rn <= {k} AND rel > 0) AS top, count_if(rn <= {k}) AS seen, min(CASE WHEN rel > 0 THEN rn END) AS first,
    sum(CASE WHEN rel > 0 THEN found / (rn * 1e0) ELSE 0e0 END) AS ap, sum(CASE WHEN rel > 0 AND rn <= {k} THEN found / (rn * 1e0) ELSE 0e0 END) AS apk,
    sum(CASE WHEN rel > 0 AND rn <= {k} THEN 1e0 / rn ELSE 0e0 END) AS arhr FROM {running} k2 GROUP BY g, query""",
)
TAGS = "query=query', rank=rank, relevance=rel"
define("retrieval", TAGS, """
recall_at_k[k=10]: avg(top / nullif(r, 0))
top_k_accuracy[k=5]: avg(CASE WHEN top > 0 THEN 1e0 ELSE 0e0 END)
precision_at_k[k=10]: avg(top / ({k} * 1e0))
map_at_k[k=10]: avg(apk / nullif(least(r, {k}), 0))
mean_average_precision[k=10]: avg(ap / nullif(r, 0))
f1_at_k[k=10]: avg(CASE WHEN r = 0 THEN NULL WHEN top = 0 THEN 0e0 ELSE 2e0 * (top / ({k} * 1e0)) * (top / (r * 1e0)) / (top / ({k} * 1e0) + top / (r * 1e0)) END)
fallout_at_k[k=10]: avg((seen - top) / nullif(n - r, 0))
success_at_k[k=10]: avg(CASE WHEN top > 0 THEN 1e0 ELSE 0e0 END)
arhr_at_k[k=10]: avg(arhr)
mrr[k=1000000]: avg(coalesce(CASE WHEN first <= {k} THEN 1e0 / first END, 0))
""", source="{per_query}", ordered=True)
define("retrieval", TAGS, "r_precision: avg(hit / nullif(r, 0))", source="(SELECT g, query, max(r) AS r, count_if(rel > 0 AND rn <= r) AS hit FROM (SELECT h.*, m.r FROM {hits} h JOIN (SELECT g, query, count_if(rel > 0) AS r FROM {t} k3 GROUP BY g, query) m ON h.g = m.g AND h.query = m.query) k4 GROUP BY g, query)", ordered=True)
define("retrieval", TAGS, "rbp[p=0.8e0]: CASE WHEN {p} > 0 AND {p} < 1 THEN avg(v) END", source="(SELECT g, query, (1 - {p}) * sum(CASE WHEN rel > 0 THEN power({p}, rn - 1) ELSE 0e0 END) AS v FROM {hits} k1 GROUP BY g, query)", ordered=True)
source("ideal", "SELECT g, query, rel, rn, row_number() OVER (PARTITION BY g, query ORDER BY rel DESC) AS best FROM {hits} k1")
define("retrieval", TAGS, "ndcg_at_k[k=10,exponential=0]: avg(dcg / nullif(idcg, 0)) FILTER (WHERE idcg > 0)", source="(SELECT g, query, sum(CASE WHEN rn <= {k} THEN CASE WHEN {exponential} = 1 THEN power(2e0, rel) - 1 ELSE rel * 1e0 END / log2(rn + 1e0) ELSE 0e0 END) AS dcg, sum(CASE WHEN best <= {k} THEN CASE WHEN {exponential} = 1 THEN power(2e0, rel) - 1 ELSE rel * 1e0 END / log2(best + 1e0) ELSE 0e0 END) AS idcg FROM {ideal} k2 GROUP BY g, query)", ordered=True)
source("graded", "SELECT h.g, h.query, h.rn, (power(2e0, h.rel) - 1) / power(2e0, m.top) AS sat, m.top FROM {hits} h JOIN (SELECT g, max(rel) AS top FROM {t} k3 GROUP BY g) m ON h.g = m.g")
source("unsated", "SELECT g, query, rn, sat, top, coalesce(exp(sum(ln(1 - sat)) OVER (PARTITION BY g, query ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1e0) AS keep FROM {graded} k5")
define("retrieval", TAGS, "err_at_k[k=10]: CASE WHEN min(top) > 0 THEN avg(v) END", source="(SELECT g, query, min(top) AS top, sum(CASE WHEN rn <= {k} THEN keep * sat / rn ELSE 0e0 END) AS v FROM {unsated} k6 GROUP BY g, query)", ordered=True)

# --- text evaluation ------------------------------------------------------------
define("llm-eval", "value=lp", "perplexity: CASE WHEN max(lp) <= 0 THEN exp(-avg(lp)) END")
define("llm-eval", "prediction=tp', reference=tr'", """
levenshtein_similarity: avg(CASE WHEN length(tp) = 0 AND length(tr) = 0 THEN 1e0 ELSE 1 - levenshtein(tp, tr) / (greatest(length(tp), length(tr)) * 1e0) END)
exact_match: avg(CASE WHEN trim(tp) = trim(tr) THEN 1e0 ELSE 0e0 END)
""")
# pass@k: 1 - C(n - c, k) / C(n, k), a product of k factors
source("problems", "SELECT g, problem, count(*) AS n, count_if(correct <> 0) AS c FROM {t} k0 GROUP BY g, problem")
source("upto_k", " UNION ALL ".join(f"SELECT {i} AS i" for i in range(100)))
source("misses", "SELECT p.g, p.problem, min(p.n) AS n, min(p.c) AS c, sum(CASE WHEN p.n - p.c - u.i > 0 THEN ln((p.n - p.c - u.i) / (p.n - u.i * 1e0)) END) AS lost FROM {problems} p JOIN {upto_k} u ON u.i < {k} GROUP BY p.g, p.problem")
define("llm-eval", "problem=problem', correct=correct", "pass_at_k[k=1]: CASE WHEN min(n) >= {k} THEN avg(CASE WHEN n - c < {k} THEN 1e0 ELSE 1 - exp(lost) END) END", source="{misses}")
# words between blanks of any kind; letters and digits of any script, without articles
WORDS = lambda c: f"filter(split({c}, '(?U)\\\\s+'), w -> w <> '')"
COUNT = lambda c: f"size({WORDS(c)})"
PLAIN = lambda c: f"filter(split(lower({c}), '[^\\\\pL\\\\pN]+'), w -> w NOT IN ('', 'a', 'an', 'the'))"
define("llm-eval", "prediction=tp', reference=tr'", f"""
wer: sum(token_edits(tp, tr)) / nullif(sum({COUNT("tr")}), 0)
token_f1: avg(token_f1_score(tp, tr))
token_jaccard: avg(coalesce(size(array_intersect({WORDS("tp")}, {WORDS("tr")})) / nullif(size(array_union({WORDS("tp")}, {WORDS("tr")})), 0), 1e0))
token_dice: avg(coalesce(2e0 * size(array_intersect({WORDS("tp")}, {WORDS("tr")})) / nullif(size(array_distinct({WORDS("tp")})) + size(array_distinct({WORDS("tr")})), 0), 1e0))
indel_similarity: avg(indel_score(tp, tr))
jaro_similarity: avg(jaro_score(tp, tr))
jaro_winkler_similarity: avg(jaro_winkler_score(tp, tr))
longest_common_subsequence: avg(lcs_length(tp, tr))
""")
define("variants", "prediction=tp', reference=tr'", f"""
exact_match_normalized: avg(CASE WHEN {PLAIN("tp")} = {PLAIN("tr")} THEN 1e0 ELSE 0e0 END)
cer: sum(levenshtein(tp, tr)) / nullif(sum(length(tr)), 0)
""")

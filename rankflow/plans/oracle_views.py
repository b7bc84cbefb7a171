"""The shared views of the correctness SQL, as named CTEs with dependencies."""

from __future__ import annotations

from rankflow.operators.catalog import CATEGORY_RULES, DEFAULT_CATEGORY
from rankflow.sources.fixtures import NO_NAME_BRAND

WORD_RUN = r"[\p{L}\p{N}_]{2,}"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x},'')),'[^a-z0-9\s]',' ','g'),'\s+',' ','g'))"


def words(x: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace(lower(coalesce({x},'')),'\s+',' ','g')),' '), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({x},''))),'{WORD_RUN}')"


def grams(t: str) -> str:
    """Unigrams and bigrams of a token list column."""
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i+1]))"


def cluster(x: str) -> str:
    w = words(x)
    return f"CASE WHEN len({w}) = 0 THEN 'unknown' ELSE array_to_string(list_slice({w},1,2),' ') END"


def l2n(e: str) -> str:
    return f"list_transform({e}, lambda x: x / greatest(sqrt(list_dot_product({e},{e})), 1e-12))"


def hash_int(*parts: str) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws(':', {joined})),1,15) AS BIGINT)"


def bucket(x: str, n: int) -> str:
    return (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(CAST({x} AS VARCHAR)),''), "
        f"lambda c: CAST(instr('0123456789abcdef',c)-1 AS BIGINT))), lambda a,c: (a*16+c)%{n})"
    )


def category_case(x: str) -> str:
    arms = " ".join(
        rf"WHEN regexp_matches(lower(coalesce({x},'')), '\b({'|'.join(w)})\b') THEN '{name}'" for name, w in CATEGORY_RULES
    )
    return f"CASE {arms} ELSE '{DEFAULT_CATEGORY}' END"


def topk(source: str, key: str, k: int, score: str = "score", item: str = "item_id", direction: str = "DESC") -> str:
    return (
        f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY {score} {direction}, {item}) AS INTEGER)"
        f" AS rank FROM {source}) WHERE rank <= {k}"
    )


def metric_columns(recall=(1, 5, 10, 20, 50), ndcg=(5, 10, 20), hit=(5, 10, 20), mrr_k=100) -> list[tuple[str, str]]:
    """(metric, expression over a per-query row with hits h@k, d@k, n_rel, first_rank)."""
    out = []
    for k in recall:
        out.append((f"recall@{k}", f'avg(CASE WHEN n_rel > 0 THEN "h@{k}" / n_rel ELSE 0.0 END)'))
    for k in ndcg:
        ideal = f"list_sum(list_transform(range(1, least(n_rel,{k})::BIGINT+1), lambda i: 1/log2(i+1)))"
        out.append((f"ndcg@{k}", f'avg(CASE WHEN n_rel > 0 THEN "d@{k}" / {ideal} ELSE 0.0 END)'))
    out.append(("mrr", f"avg(CASE WHEN first_rank <= {mrr_k} THEN 1.0/first_rank ELSE 0.0 END)"))
    for k in hit:
        out.append((f"hit_rate@{k}", f'avg(CASE WHEN "h@{k}" > 0 THEN 1.0 ELSE 0.0 END)'))
    return out


def per_query(ranked: str, relevant: str, queries: str, recall=(1, 5, 10, 20, 50), ndcg=(5, 10, 20), hit=(5, 10, 20)) -> str:
    """Per-query hit counts by brute force: every ranked row is tested against the relevance set."""
    ks = sorted(set(recall) | set(hit))
    h = ", ".join(f'count(DISTINCT CASE WHEN rank <= {k} THEN item_id END) AS "h@{k}"' for k in ks)
    d = ", ".join(f'coalesce(sum(CASE WHEN rank <= {k} THEN 1/log2(rank+1) END),0) AS "d@{k}"' for k in ndcg)
    cols = ", ".join(x for x in (h, d, "min(rank) AS first_rank") if x)
    zeros = ", ".join([f'coalesce("h@{k}",0) AS "h@{k}"' for k in ks] + [f'coalesce("d@{k}",0.0) AS "d@{k}"' for k in ndcg])
    zeros = (zeros + ", ") if zeros else ""
    return f"""SELECT q.query_id, coalesce(n_rel,0) AS n_rel, {zeros}first_rank
      FROM (SELECT DISTINCT query_id FROM {queries}) q
      LEFT JOIN (SELECT query_id, count(DISTINCT item_id) AS n_rel FROM {relevant} GROUP BY 1) g ON g.query_id = q.query_id
      LEFT JOIN (SELECT r.query_id, {cols} FROM {ranked} r
                 WHERE EXISTS (SELECT 1 FROM {relevant} x WHERE x.query_id = r.query_id AND x.item_id = r.item_id)
                 GROUP BY 1) h ON h.query_id = q.query_id"""


def metric_rows(source: str, names: list[tuple[str, str]], prefix: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {prefix}'{n}' AS metric, round(coalesce({e},0.0),6) AS value FROM {source}" for n, e in names
    )


IDS = "o_custkey, l_partkey, l_orderkey, l_linenumber, l_suppkey, CAST(ceil(l_quantity/10) AS BIGINT)"

VIEWS: dict[str, tuple[list[str], str]] = {
    "interactions": (
        [],
        f"""SELECT o_custkey AS user_id, l_partkey AS product_id, CAST(ceil(l_quantity/10) AS DOUBLE) AS score,
        CAST(epoch(o_orderdate) AS BIGINT) AS timestamp, p_name AS title, lower(p_type) AS summary,
        md5(concat_ws('|', {IDS})) AS row_key
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    ),
    "labeled": (
        ["interactions"],
        """SELECT *, CASE WHEN score >= 4 THEN 1 ELSE 0 END AS label FROM interactions WHERE score >= 4 OR score <= 2""",
    ),
    "splits": (
        ["labeled"],
        """SELECT * EXCLUDE (rn, n), CASE WHEN rn <= n*70//100 THEN 'train' WHEN rn <= n*85//100 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY timestamp, row_key) AS rn, count(*) OVER () AS n FROM labeled)""",
    ),
    "brands": ([], f"SELECT p_partkey AS product_id, p_brand AS brand FROM part WHERE p_brand <> '{NO_NAME_BRAND}'"),
    "catalog": (
        ["interactions", "brands"],
        f"""SELECT product_id, title, brand, {clean("title || ' ' || brand || ' ' || array_to_string(list_slice(" + words("summary") + ",1,30),' ')")} AS cleaned_text,
        {category_case("title")} AS category_id, review_count
        FROM (SELECT i.product_id, title, summary, coalesce(b.brand,'unknown') AS brand, review_count
          FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY timestamp, title, summary) AS rn,
                count(*) OVER (PARTITION BY product_id) AS review_count FROM interactions) i
          LEFT JOIN brands b ON b.product_id = i.product_id WHERE rn = 1)""",
    ),
    "title_queries": (
        ["catalog"],
        f"SELECT 't-' || product_id AS query_id, product_id, {clean('title')} AS query_text FROM catalog",
    ),
    "ngram_queries": (
        ["catalog"],
        f"""SELECT 'n-' || product_id || '-' || i AS query_id, product_id, gram AS query_text FROM (
          SELECT product_id, gram, row_number() OVER (PARTITION BY product_id ORDER BY md5(concat_ws(':','42',CAST(product_id AS VARCHAR),gram)), gram) AS i
          FROM (SELECT DISTINCT product_id, unnest(CASE WHEN len(w) >= 2 THEN list_concat(
              list_transform(range(1,len(w)), lambda i: w[i] || ' ' || w[i+1]),
              list_transform(range(1,len(w)-1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) ELSE [array_to_string(w,' ')] END) AS gram
            FROM (SELECT product_id, {words(clean('title'))} AS w FROM catalog))) WHERE i <= 3""",
    ),
    "rich_queries": (
        ["catalog"],
        f"SELECT 'r-' || product_id AS query_id, product_id, {clean("p_type || ' ' || title")} AS query_text FROM catalog JOIN part ON p_partkey = product_id",
    ),
    "doc_terms": (
        ["catalog"],
        f"""SELECT product_id, term, count(*) AS tf FROM (SELECT product_id, unnest({grams('t')}) AS term
        FROM (SELECT product_id, {tokens('cleaned_text')} AS t FROM catalog)) GROUP BY 1,2""",
    ),
    "idf": (
        ["doc_terms", "catalog"],
        """SELECT term, count(*) AS df, ln((1.0+(SELECT count(*) FROM catalog))/(1.0+count(*)))+1.0 AS idf
        FROM doc_terms GROUP BY 1""",
    ),
    "postings": (
        ["doc_terms", "idf"],
        """SELECT product_id, term, w / sqrt(sum(w*w) OVER (PARTITION BY product_id)) AS weight
        FROM (SELECT product_id, term, (1.0+ln(tf))*idf AS w FROM doc_terms JOIN idf USING (term))""",
    ),
    "texts": (["title_queries"], "SELECT DISTINCT query_text FROM title_queries"),
    "text_weights": (
        ["texts", "idf"],
        f"""SELECT query_text, term, w / sqrt(sum(w*w) OVER (PARTITION BY query_text)) AS weight
        FROM (SELECT query_text, term, (1.0+ln(count(*)))*any_value(idf) AS w
          FROM (SELECT query_text, unnest({grams('t')}) AS term FROM (SELECT query_text, {tokens('query_text')} AS t FROM texts))
          JOIN idf USING (term) GROUP BY 1,2)""",
    ),
    "text_scores": (
        ["text_weights", "postings"],
        """SELECT query_text, p.product_id AS item_id, round(sum(q.weight*p.weight),9) AS score
        FROM text_weights q JOIN postings p USING (term) GROUP BY 1,2""",
    ),
    "text_top": (["text_scores"], topk("text_scores", "query_text", 200)),
    "pv": ([], "SELECT vec_id AS product_id, embedding::DOUBLE[] AS e, label FROM embeddings"),
    "title_vectors": (
        ["pv", "catalog"],
        f"""SELECT query_text, {l2n('v')} AS e FROM (SELECT query_text, list(x ORDER BY pos) AS v FROM (
          SELECT query_text, pos, avg(x) AS x FROM (SELECT {clean('title')} AS query_text, unnest(e) AS x, generate_subscripts(e,1) AS pos
            FROM pv JOIN catalog USING (product_id)) GROUP BY 1,2) GROUP BY 1)""",
    ),
    "centroids": (
        ["pv"],
        f"""SELECT label AS cell, {l2n('v')} AS e FROM (SELECT label, list(x ORDER BY pos) AS v FROM (
          SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e,1) AS pos FROM pv) GROUP BY 1,2) GROUP BY 1)""",
    ),
    "self_scores": (
        ["pv"],
        "SELECT a.product_id AS query_key, b.product_id AS item_id, round(list_dot_product(a.e,b.e),9) AS score FROM pv a, pv b",
    ),
    "self_top": (["self_scores"], topk("self_scores", "query_key", 100)),
    "requests": (
        ["splits", "title_queries", "catalog"],
        """SELECT s.split, row_number() OVER (PARTITION BY s.split ORDER BY s.timestamp, s.row_key) AS query_idx,
        s.user_id, s.product_id, q.query_text, c.category_id AS category, s.timestamp, s.row_key
        FROM splits s JOIN title_queries q USING (product_id) JOIN catalog c USING (product_id) WHERE s.label = 1""",
    ),
    "title_candidates": (
        ["title_vectors", "pv"],
        "SELECT * FROM (" + topk("(SELECT query_text, product_id AS item_id, round(list_dot_product(q.e,p.e),9) AS score FROM title_vectors q, pv p)", "query_text", 200) + ")",
    ),
    "candidates": (
        ["requests", "title_candidates"],
        """SELECT r.split, r.query_idx, r.user_id, r.product_id AS target_product_id, r.category AS query_category, r.query_text,
        t.item_id AS candidate_product_id, t.rank AS retrieval_rank, t.score AS similarity_score,
        CASE WHEN t.item_id = r.product_id THEN 1 ELSE 0 END AS label
        FROM requests r JOIN title_candidates t USING (query_text)""",
    ),
    "product_features": (
        ["splits", "catalog"],
        """SELECT c.product_id, c.category_id AS category,
        coalesce((ctr*n+10*prior)/(n+10), prior) AS global_ctr, coalesce(ln(1+n)/ln(1+max_n),0.0) AS product_popularity
        FROM catalog c LEFT JOIN (SELECT product_id, avg(least(greatest((score-1)/4,0),1)) AS ctr, count(*) AS n FROM splits WHERE split='train' GROUP BY 1) s USING (product_id)
        CROSS JOIN (SELECT avg(ctr) AS prior, max(n) AS max_n FROM (SELECT avg(least(greatest((score-1)/4,0),1)) AS ctr, count(*) AS n FROM splits WHERE split='train' GROUP BY product_id))""",
    ),
    "affinity": (
        ["splits", "catalog"],
        """SELECT user_id, category_id AS category, (sum(label)+5*(SELECT avg(label) FROM splits WHERE split='train'))/(count(*)+5) AS affinity
        FROM splits JOIN catalog USING (product_id) WHERE split='train' GROUP BY 1,2""",
    ),
    "features": (
        ["candidates", "product_features", "affinity"],
        """SELECT c.*, coalesce(f.category,'unknown') AS candidate_category,
        CASE WHEN f.category = c.query_category THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category_match_binary,
        coalesce(f.global_ctr,0.0) AS historical_global_ctr, coalesce(a.affinity,0.0) AS user_category_affinity,
        coalesce(f.product_popularity,0.0) AS product_popularity
        FROM candidates c LEFT JOIN product_features f ON f.product_id = c.candidate_product_id
        LEFT JOIN affinity a ON a.user_id = c.user_id AND a.category = coalesce(f.category,'unknown')""",
    ),
    "cluster_entropy": (
        ["splits", "rich_queries", "catalog"],
        f"""SELECT query_cluster_id, greatest(-sum(p*log2(p)),0) AS entropy FROM (
          SELECT query_cluster_id, n / sum(n) OVER (PARTITION BY query_cluster_id) AS p FROM (
            SELECT {cluster('query_text')} AS query_cluster_id, category_id, count(*) AS n FROM splits JOIN rich_queries USING (product_id)
            JOIN catalog USING (product_id) WHERE split='train' AND label=1 GROUP BY 1,2)) GROUP BY 1""",
    ),
    "explore_frame": (
        ["features", "rich_queries", "cluster_entropy"],
        f"""SELECT f.split, f.query_idx, f.user_id, f.target_product_id, f.candidate_product_id, f.candidate_category, f.retrieval_rank,
        f.similarity_score, r.query_text, {cluster('r.query_text')} AS query_cluster_id, coalesce(e.entropy,0.0) AS query_cluster_entropy,
        (similarity_score - (min(similarity_score) OVER ())) / greatest((max(similarity_score) OVER ()) - (min(similarity_score) OVER ()),1e-12) AS base_score
        FROM features f JOIN rich_queries r ON r.product_id = f.target_product_id
        LEFT JOIN cluster_entropy e ON e.query_cluster_id = {cluster('r.query_text')} WHERE f.split = 'test'""",
    ),
    "base_ranked": (
        ["explore_frame"],
        """SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY base_score DESC, retrieval_rank, candidate_product_id) AS base_rank FROM explore_frame""",
    ),
    "baseline_topk": (["base_ranked"], "SELECT *, base_rank AS final_rank FROM base_ranked WHERE base_rank <= 10"),
    "capped_topk": (
        ["base_ranked"],
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY skip, base_rank) AS final_rank FROM (
          SELECT *, CASE WHEN (query_cluster_entropy >= 2.2) AND row_number() OVER (PARTITION BY query_idx, candidate_category ORDER BY base_rank) > 3
            THEN 1 ELSE 0 END AS skip FROM base_ranked)) WHERE final_rank <= 10""",
    ),
    "popularity": (
        ["splits"],
        "SELECT product_id, count(*) AS n FROM splits WHERE split='train' GROUP BY 1",
    ),
    "pop_list": (
        ["splits"],
        """SELECT item_id, n, CAST(row_number() OVER (ORDER BY n DESC, item_id) AS INTEGER) AS rank FROM (
          SELECT product_id AS item_id, count(*) AS n FROM splits WHERE split='train' AND label=1 GROUP BY 1) QUALIFY rank <= 200""",
    ),
    "user_truth": (
        ["splits"],
        "SELECT user_id AS query_id, product_id AS item_id, count(*) AS n FROM splits WHERE split='test' AND label=1 GROUP BY 1,2",
    ),
    "text_truth": (
        ["splits", "title_queries"],
        """SELECT query_text AS query_id, product_id AS item_id, count(*) AS gain FROM splits JOIN title_queries USING (product_id)
        WHERE split='test' AND label=1 GROUP BY 1,2""",
    ),
    "all_texts": (["texts"], "SELECT query_text AS query_id FROM texts"),
    "text_ranked": (["text_top"], "SELECT query_text AS query_id, rank, item_id FROM text_top"),
}


def sql(select: str, *needs: str) -> str:
    """``select`` with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return select
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    return f"WITH {ctes}\n{select}"

"""Oracle SQL (DuckDB dialect) for the registered queries.

Written independently of the Spark code path: the split is the same md5 test,
training is a recursive CTE carrying one weight list per problem (a LATERAL
subquery computes each step's sub-gradient), k-means is a recursive CTE over
the two centres, the tree layout is a recursive CTE over class lists, and the
tree walk is a recursive CTE over (row, node).
"""

from __future__ import annotations

from multisvm.operators.trainer import SGDParams
from multisvm.plans import queries as Q

R = Q.DIGITS


def rnd(expr: str) -> str:
    return f"(round({expr}, {R}) + 0.0)"


# Hash bounds of the fractions used, in 32 bits, and the run of each among 1024 buckets.
BOUNDS = {0.25: "40000000", 0.5: "80000000"}
RUNS = {0.25: 256, 0.5: 512}


def _in_fraction(salt_sql: str, key_sql: str, fraction: float) -> str:
    if fraction >= 1:
        return "TRUE"
    return f"substr(md5(concat({salt_sql}, ':', CAST({key_sql} AS VARCHAR))), 1, 8) < '{BOUNDS[fraction]}'"


def _embeddings_src(split: str) -> list[str]:
    return [f"""src AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS f,
         CASE WHEN {split.format(key='vec_id')} THEN 'train' ELSE 'test' END AS split
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"""]


def _columns_src(table: str, cols: list[str], label: str, key: str, split: str) -> list[str]:
    maxes = ", ".join(f"max(abs(CAST({c} AS DOUBLE))) AS m{i}" for i, c in enumerate(cols))
    feats = ", ".join(f"CAST({c} AS DOUBLE) / CASE WHEN s.m{i} IS NULL OR s.m{i} = 0 THEN 1.0 ELSE s.m{i} END"
                      for i, c in enumerate(cols))
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [label] + cols)
    return [
        f"scale AS (SELECT {maxes} FROM {table} WHERE {complete})",
        f"""src AS (
  SELECT {key} AS id,
         CAST(dense_rank() OVER (ORDER BY {label}) - 1 AS INTEGER) AS label,
         [{feats}] AS f,
         CASE WHEN {split.format(key=key)} THEN 'train' ELSE 'test' END AS split
  FROM {table} CROSS JOIN scale s WHERE {complete})""",
    ]


def _lineitem_src(split: str) -> list[str]:
    key = "concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
    return _columns_src("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag", key, split)


def _part_src(split: str) -> list[str]:
    return _columns_src("part", ["p_size", "p_retailprice", "p_partkey"], "p_brand", "p_partkey", split)


def base_ctes(table: str = "embeddings") -> list[str]:
    split = _in_fraction(f"'{Q.SEED}'", "{key}", Q.TRAIN_FRACTION)
    src = {"embeddings": _embeddings_src, "lineitem": _lineitem_src, "part": _part_src}[table](split)
    return src + [
        "train AS (SELECT id, label, f FROM src WHERE split = 'train')",
        """cls AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_index, count(*) AS n_rows
  FROM train GROUP BY label)""",
        "dims AS (SELECT max(len(f)) AS d FROM train)",
    ]


def ova_code() -> list[str]:
    return ["""code AS (
  SELECT a.label, b.class_index AS problem, CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS y
  FROM cls a CROSS JOIN cls b)"""]


def ovo_code() -> list[str]:
    return [
        """pairs AS (
  SELECT CAST(row_number() OVER (ORDER BY a.class_index, b.class_index) - 1 AS INTEGER) AS problem,
         a.label AS pos_label, b.label AS neg_label
  FROM cls a JOIN cls b ON a.class_index < b.class_index)""",
        """code AS (
  SELECT pos_label AS label, problem, 1 AS y FROM pairs
  UNION ALL SELECT neg_label AS label, problem, -1 AS y FROM pairs)""",
    ]


def kmeans_ctes(max_iter: int, tol: float) -> list[str]:
    """Lloyd from the lowest-id and highest-id rows; stop when no centre moves > tol."""
    sq = "lambda z: (z[1] - z[2]) * (z[1] - z[2])"
    return [
        "km_init AS (SELECT [arg_min(f, id), arg_max(f, id)] AS c FROM train)",
        f"""km(t, c, done) AS (
  SELECT 0, c, false FROM km_init
  UNION ALL
  SELECT k.t + 1, u.nc, u.conv
  FROM km k, LATERAL (
    SELECT list(nc ORDER BY cl) AS nc, bool_and(moved <= CAST({tol!r} AS DOUBLE) * CAST({tol!r} AS DOUBLE)) AS conv FROM (
      SELECT cl.cl,
             CASE WHEN agg.cnt IS NULL THEN k.c[cl.cl + 1] ELSE agg.mean END AS nc,
             list_sum(list_transform(list_zip(CASE WHEN agg.cnt IS NULL THEN k.c[cl.cl + 1] ELSE agg.mean END,
                                              k.c[cl.cl + 1]), {sq})) AS moved
      FROM (SELECT unnest([0, 1]) AS cl) cl
      LEFT JOIN (
        SELECT cl, any_value(cnt) AS cnt, list(s / cnt ORDER BY j) AS mean FROM (
          SELECT cl, j, sum(v) AS s, any_value(cnt) AS cnt FROM (
            SELECT a.cl, unnest(a.f) AS v, generate_subscripts(a.f, 1) AS j, count(*) OVER (PARTITION BY a.cl) AS cnt
            FROM (
              SELECT r.f,
                     CASE WHEN list_sum(list_transform(list_zip(r.f, k.c[2]), {sq}))
                             < list_sum(list_transform(list_zip(r.f, k.c[1]), {sq})) THEN 1 ELSE 0 END AS cl
              FROM train r) a
          ) GROUP BY cl, j
        ) GROUP BY cl
      ) agg ON agg.cl = cl.cl
    )
  ) u
  WHERE k.t < {max_iter} AND NOT k.done)""",
        "centres AS (SELECT arg_max(c, t) AS c FROM km)",
        f"""assigned AS (
  SELECT r.id, r.label,
         list_sum(list_transform(list_zip(r.f, c.c[1]), {sq})) AS d0,
         list_sum(list_transform(list_zip(r.f, c.c[2]), {sq})) AS d1,
         CASE WHEN d1 < d0 THEN 1 ELSE 0 END AS cluster,
         CASE WHEN d1 < d0 THEN d1 ELSE d0 END AS distance
  FROM train r CROSS JOIN centres c)""",
        "cc AS (SELECT label, cluster, count(*) AS n FROM assigned GROUP BY label, cluster)",
        """c2c AS (
  SELECT label, any_value(cluster) FILTER (WHERE rk = 1) AS cluster, min(n) * min(n) AS err FROM (
    SELECT label, cluster, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, cluster ASC) AS rk FROM cc)
  GROUP BY label)""",
    ]


def tree_ctes() -> list[str]:
    half = "((len({l}) + 1) // 2)"
    hp, hn = half.format(l="t.pos"), half.format(l="t.neg")
    return kmeans_ctes(Q.kmeans_iterations(), Q.KMEANS_TOL) + [
        """sides AS (
  SELECT coalesce(list(label ORDER BY err, label) FILTER (WHERE cluster = 1), []) AS s1,
         coalesce(list(label ORDER BY err, label) FILTER (WHERE cluster = 0), []) AS s0
  FROM c2c)""",
        """root AS (
  SELECT CASE WHEN len(s1) = 0 OR len(s0) = 0 THEN (s1 || s0)[1:(len(s1) + len(s0) + 1) // 2] ELSE s1 END AS pos,
         CASE WHEN len(s1) = 0 OR len(s0) = 0 THEN (s1 || s0)[(len(s1) + len(s0) + 1) // 2 + 1:] ELSE s0 END AS neg
  FROM sides WHERE len(s1) + len(s0) >= 2)""",
        f"""tree(node, pos, neg) AS (
  SELECT 0, pos, neg FROM root
  UNION ALL
  SELECT ch.node, ch.pos, ch.neg FROM tree t, LATERAL (
    SELECT t.node + 1 AS node, t.pos[1:{hp}] AS pos, t.pos[{hp} + 1:] AS neg WHERE len(t.pos) > 1
    UNION ALL
    SELECT t.node + len(t.pos) AS node, t.neg[1:{hn}] AS pos, t.neg[{hn} + 1:] AS neg WHERE len(t.neg) > 1
  ) ch)""",
        """nodes AS (
  SELECT node, pos, neg,
         CASE WHEN len(pos) > 1 THEN node + 1 ELSE -1 END AS pos_child,
         CASE WHEN len(neg) > 1 THEN node + len(pos) ELSE -1 END AS neg_child,
         CASE WHEN len(pos) = 1 THEN pos[1] ELSE -1 END AS pos_label,
         CASE WHEN len(neg) = 1 THEN neg[1] ELSE -1 END AS neg_label
  FROM tree)""",
        """code AS (
  SELECT unnest(pos) AS label, node AS problem, 1 AS y FROM nodes
  UNION ALL SELECT unnest(neg) AS label, node AS problem, -1 AS y FROM nodes)""",
    ]


def train_ctes(p: SGDParams) -> list[str]:
    """Recursive mini-batch sub-gradient descent over every problem in ``code``."""
    eta = f"({p.step!r} / sqrt(s.t + 1))"
    batch = _in_fraction(f"concat('{p.seed}:', CAST(s.t + 1 AS VARCHAR))", "r.id", p.fraction)
    if p.bucketed:
        b, w = 1024, RUNS[p.fraction]
        bucket = f"CAST(('0x' || substr(md5(concat('{p.seed}:bucket', ':', CAST(r.id AS VARCHAR))), 1, 8)) AS BIGINT) % {b}"
        offset = f"CAST(('0x' || substr(md5(concat('{p.seed}', ':', CAST(s.t + 1 AS VARCHAR))), 1, 8)) AS BIGINT) % {b}"
        batch = f"((({bucket}) - ({offset})) % {b} + {b}) % {b} < {w}"
    zero = "list_transform(range((SELECT d FROM dims)), lambda i: CAST(0.0 AS DOUBLE))"
    sq = "lambda z: (z[1] - z[2]) * (z[1] - z[2])"
    return [
        "problems AS (SELECT DISTINCT problem FROM code)",
        f"""st(t, problem, w, upd, done) AS (
  SELECT 0, problem, {zero}, 0, false FROM problems
  UNION ALL
  SELECT s.t + 1, s.problem,
         CASE WHEN g.n = 0 THEN s.w ELSE g.nw END,
         s.upd + CASE WHEN g.n = 0 THEN 0 ELSE 1 END,
         CASE WHEN g.n = 0 OR s.upd = 0 THEN false
              ELSE sqrt(list_sum(list_transform(list_zip(g.nw, s.w), {sq})))
                   < {p.tol!r} * greatest(sqrt(list_sum(list_transform(g.nw, lambda v: v * v))), 1.0) END
  FROM st s, LATERAL (
    SELECT q.n,
           list_transform(list_zip(s.w, coalesce(q.grad, {zero})),
                          lambda z: z[1] * (1.0 - {eta} * {p.reg!r}) + (-{eta}) * (z[2] / q.n)) AS nw
    FROM (SELECT
      (SELECT count(*) FROM train r JOIN code c ON c.label = r.label
        WHERE c.problem = s.problem AND {batch}) AS n,
      (SELECT list(gs ORDER BY j) FROM (
         SELECT j, sum(-y * v) AS gs FROM (
           SELECT c.y, unnest(r.f) AS v, generate_subscripts(r.f, 1) AS j
           FROM train r JOIN code c ON c.label = r.label
           WHERE c.problem = s.problem AND {batch} AND c.y * list_dot_product(s.w, r.f) < 1.0)
         GROUP BY j)) AS grad) q
  ) g
  WHERE s.t < {p.iterations} AND NOT s.done)""",
        "model AS (SELECT problem, arg_max(w, t) AS w FROM st GROUP BY problem)",
        # Row-wise margins (list in problem order): no join on id, so repeated keys keep every row.
        """rowm AS (
  SELECT s.id, s.label, s.split,
         list_transform((SELECT list(w ORDER BY problem) FROM model), lambda w: list_dot_product(s.f, w)) AS mm
  FROM src s)""",
    ]


def ova_predict() -> list[str]:
    """First maximum of the row's margins wins (lowest class)."""
    return ["""pred AS (
  SELECT id, label, split,
         (SELECT list(label ORDER BY class_index) FROM cls)[list_position(mm, list_max(mm))] AS prediction
  FROM rowm)"""]


def ovo_predict() -> list[str]:
    """Each pair votes (margin >= 0: positive label); most votes, then lowest label, wins."""
    return [
        """pair_lists AS (
  SELECT list(pos_label ORDER BY problem) AS pos, list(neg_label ORDER BY problem) AS neg,
         (SELECT list(label ORDER BY label) FROM cls) AS classes
  FROM pairs)""",
        """row_votes AS (
  SELECT r.id, r.label, r.split, p.classes,
         list_transform(p.classes, lambda c: CAST(len(list_filter(
           list_transform(range(1, len(r.mm) + 1),
                          lambda i: CASE WHEN r.mm[i] >= 0 THEN p.pos[i] ELSE p.neg[i] END),
           lambda w: w = c)) AS BIGINT)) AS v
  FROM rowm r CROSS JOIN pair_lists p)""",
        """votes AS (
  SELECT id, label, split, unnest(classes) AS class, unnest(v) AS votes FROM row_votes)""",
        """pred AS (
  SELECT id, label, split, classes[list_position(v, list_max(v))] AS prediction FROM row_votes)""",
    ]


def tree_predict() -> list[str]:
    """Walk each row down the tree with its own margins list (margin >= 0: positive side)."""
    return [
        """walk(id, label, split, mm, node, prediction) AS (
  SELECT id, label, split, mm, 0, -1 FROM rowm
  UNION ALL
  SELECT w.id, w.label, w.split, w.mm,
         CASE WHEN w.mm[w.node + 1] >= 0 THEN n.pos_child ELSE n.neg_child END,
         CASE WHEN w.mm[w.node + 1] >= 0 THEN n.pos_label ELSE n.neg_label END
  FROM walk w JOIN nodes n ON n.node = w.node
  WHERE w.node >= 0)""",
        "pred AS (SELECT id, label, split, CAST(prediction AS INTEGER) AS prediction FROM walk WHERE node = -1)",
    ]


def confusion_ctes() -> list[str]:
    return ["conf AS (SELECT label, prediction, count(*) AS n FROM pred WHERE split = 'test' GROUP BY label, prediction)"]


BY_LABEL = """SELECT label, n_label, tp, fp,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
       CAST(tp AS DOUBLE) / CAST(n_label AS DOUBLE) AS recall,
       CASE WHEN total - n_label = 0 THEN NULL ELSE CAST(fp AS DOUBLE) / CAST(total - n_label AS DOUBLE) END
         AS false_positive_rate,
       CASE WHEN (CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END)
                 + CAST(tp AS DOUBLE) / CAST(n_label AS DOUBLE) = 0 THEN 0.0
            ELSE 2.0 * (CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END)
                 * (CAST(tp AS DOUBLE) / CAST(n_label AS DOUBLE))
                 / ((CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END)
                    + CAST(tp AS DOUBLE) / CAST(n_label AS DOUBLE)) END AS f1
FROM (
  SELECT t.label, CAST(t.n_label AS BIGINT) AS n_label, CAST(t.tp AS BIGINT) AS tp,
         CAST(coalesce(p.fp, 0) AS BIGINT) AS fp, CAST(sum(t.n_label) OVER () AS BIGINT) AS total
  FROM (SELECT label, sum(n) AS n_label, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp
        FROM conf GROUP BY label) t
  LEFT JOIN (SELECT prediction AS label, sum(CASE WHEN label <> prediction THEN n ELSE 0 END) AS fp
             FROM conf GROUP BY prediction) p ON p.label = t.label)"""

SUMMARY = """SELECT n_train, n_test, correct_train, correct_test,
       CASE WHEN n_train > 0 THEN CAST(correct_train AS DOUBLE) / CAST(n_train AS DOUBLE) END AS train_accuracy,
       CASE WHEN n_test > 0 THEN CAST(correct_test AS DOUBLE) / CAST(n_test AS DOUBLE) END AS test_accuracy
FROM (
  SELECT CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
         CAST(sum(CASE WHEN split = 'train' THEN 0 ELSE 1 END) AS BIGINT) AS n_test,
         CAST(sum(CASE WHEN split = 'train' AND label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct_train,
         CAST(sum(CASE WHEN split <> 'train' AND label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct_test
  FROM pred)"""


def sql(ctes: list[str], body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body


def _scheme(scheme: str, table: str = "embeddings", params=None) -> tuple[list[str], list[str]]:
    code = {"ova": ova_code(), "ovo": ovo_code(), "tree": tree_ctes()}[scheme]
    pred = {"ova": ova_predict(), "ovo": ovo_predict(), "tree": tree_predict()}[scheme]
    return base_ctes(table) + code + train_ctes(params or Q.PARAMS[scheme]), pred


def _weights_body(extra_select: str = "", extra_join: str = "") -> str:
    return f"""SELECT CAST(m.problem AS INTEGER) AS problem{extra_select}, CAST(j - 1 AS INTEGER) AS feature, {rnd('w')} AS weight FROM (
  SELECT problem, unnest(w) AS w, generate_subscripts(w, 1) AS j FROM model) m{extra_join}"""


def roundtrip_sql(keys: str = "", of: str = "embeddings") -> str:
    return f"""SELECT {keys}label, CAST(j - 1 AS INTEGER) AS feature, count(*) AS n_rows,
       (round(sum(v), 6) + 0.0) AS sum_values, (round(sum(v * v), 6) + 0.0) AS sum_squares
FROM (
  SELECT {keys}label, unnest(f) AS v, generate_subscripts(f, 1) AS j FROM {of})
GROUP BY {keys}label, j"""


def oracle_sql() -> dict[str, str]:
    base = base_ctes()
    out: dict[str, str] = {}
    out["train_test_split"] = sql(base, "SELECT id, label, split FROM src")
    out["class_inventory"] = sql(base, "SELECT label, class_index, n_rows FROM cls")
    out["binarize_one_vs_rest"] = sql(base + ova_code(),
                                      "SELECT r.id, r.label, CAST(c.problem AS INTEGER) AS problem, CAST(c.y AS INTEGER) AS y FROM train r JOIN code c ON c.label = r.label")
    out["binarize_pair"] = sql(base + ovo_code(),
                               "SELECT r.id, r.label, CAST(c.problem AS INTEGER) AS problem, CAST(c.y AS INTEGER) AS y FROM train r JOIN code c ON c.label = r.label")
    tree = base + tree_ctes()
    out["binarize_class_set"] = sql(tree, "SELECT r.id, r.label, CAST(c.problem AS INTEGER) AS problem, CAST(c.y AS INTEGER) AS y FROM train r JOIN code c ON c.label = r.label",
                                    recursive=True)
    out["filter_class_set"] = sql(tree, "SELECT id, label FROM train WHERE list_contains((SELECT pos FROM nodes WHERE node = 0), label)",
                                  recursive=True)
    out["svm_gradient_step"] = sql(base + ova_code(), f"""SELECT problem, CAST(j - 1 AS INTEGER) AS feature,
       {rnd('sum(CASE WHEN y * list_dot_product(w, f) < 1.0 THEN -y * v ELSE 0.0 END)')} AS grad, count(*) AS n_rows
FROM (SELECT c.problem, c.y, x.f, unnest(x.f) AS v, generate_subscripts(x.f, 1) AS j,
        list_transform(range((SELECT d FROM dims)), lambda i: CAST((c.problem * 7 + i * 3) % 11 - 5 AS DOUBLE) * CAST(0.6 AS DOUBLE)) AS w
      FROM train x JOIN code c ON c.label = x.label)
GROUP BY problem, j""")
    binary_code = ["code AS (SELECT label, 0 AS problem, CASE WHEN class_index = 0 THEN 1 ELSE -1 END AS y FROM cls)"]
    out["svm_binary"] = sql(base + binary_code + train_ctes(Q.BINARY_PARAMS),
                            f"SELECT CAST(j - 1 AS INTEGER) AS feature, {rnd('w')} AS weight FROM "
                            "(SELECT unnest(w) AS w, generate_subscripts(w, 1) AS j FROM model)", recursive=True)

    for scheme in ("ova", "ovo", "tree"):
        ctes, pred = _scheme(scheme)
        out[f"score_{scheme}"] = sql(ctes + pred, "SELECT id, label, split, prediction FROM pred", recursive=True)
        out[f"{scheme}_confusion_matrix"] = sql(ctes + pred + confusion_ctes(),
                                                "SELECT label, prediction, n FROM conf", recursive=True)
        out[f"{scheme}_metrics_by_label"] = sql(ctes + pred + confusion_ctes(), BY_LABEL, recursive=True)
        out[f"{scheme}_metrics_summary"] = sql(ctes + pred, SUMMARY, recursive=True)

    ova, _ = _scheme("ova")
    out["train_ova"] = sql(ova, _weights_body(", c.label", " JOIN cls c ON c.class_index = m.problem"), recursive=True)
    out["ova_margins"] = sql(ova, f"""SELECT id, CAST(p - 1 AS INTEGER) AS problem, {rnd('m')} AS margin FROM (
  SELECT id, unnest(mm) AS m, generate_subscripts(mm, 1) AS p FROM rowm)""", recursive=True)
    ovo, ovo_pred = _scheme("ovo")
    out["train_ovo"] = sql(ovo, _weights_body(", p.pos_label, p.neg_label", " JOIN pairs p ON p.problem = m.problem"),
                           recursive=True)
    out["ovo_votes"] = sql(ovo + ovo_pred, "SELECT id, class, votes FROM votes", recursive=True)
    tree_all, _ = _scheme("tree")
    out["train_tree"] = sql(tree_all, _weights_body().replace("AS INTEGER) AS problem", "AS INTEGER) AS node"),
                            recursive=True)

    km = base + kmeans_ctes(Q.kmeans_iterations(), Q.KMEANS_TOL)
    out["kmeans_lloyd"] = sql(km, f"""SELECT CAST(cl - 1 AS INTEGER) AS cluster, CAST(j - 1 AS INTEGER) AS feature,
       {rnd('v')} AS centre FROM (
  SELECT cl, unnest(c[cl]) AS v, generate_subscripts(c[cl], 1) AS j FROM centres, (SELECT unnest([1, 2]) AS cl))""",
                              recursive=True)
    out["kmeans_assign"] = sql(km, "SELECT id, CAST(cluster AS INTEGER) AS cluster FROM assigned", recursive=True)
    out["kmeans_cost"] = sql(km, f"SELECT {rnd('sum(distance)')} AS cost, count(*) AS n_rows FROM assigned",
                             recursive=True)
    out["class_cluster_counts"] = sql(km, "SELECT label, CAST(cluster AS INTEGER) AS cluster, n FROM cc",
                                      recursive=True)
    out["class_to_cluster"] = sql(km, "SELECT label, CAST(cluster AS INTEGER) AS cluster, CAST(err AS BIGINT) AS err FROM c2c",
                                  recursive=True)
    out["cluster_class_order"] = sql(km, """SELECT CAST(cluster AS INTEGER) AS cluster,
       CAST(row_number() OVER (PARTITION BY cluster ORDER BY err, label) - 1 AS INTEGER) AS position, label FROM c2c""",
                                     recursive=True)
    out["tree_layout"] = sql(tree, """SELECT CAST(node AS INTEGER) AS node, CAST(pos_child AS INTEGER) AS pos_child,
       CAST(neg_child AS INTEGER) AS neg_child, CAST(pos_label AS INTEGER) AS pos_label,
       CAST(neg_label AS INTEGER) AS neg_label, CAST(len(pos) AS INTEGER) AS n_pos, CAST(len(neg) AS INTEGER) AS n_neg
FROM nodes""", recursive=True)
    out["confusion_matrix"] = out["ova_confusion_matrix"]
    out["metrics_by_label"] = out["ova_metrics_by_label"]
    out["metrics_summary"] = out["ova_metrics_summary"]
    li, li_pred = _scheme("ova", "lineitem")
    out["lineitem_train_ova"] = sql(li, _weights_body(", c.label", " JOIN cls c ON c.class_index = m.problem"),
                                    recursive=True)
    out["lineitem_ova_metrics_summary"] = sql(li + li_pred, SUMMARY, recursive=True)
    for scheme in ("ovo", "tree"):
        lc, lp = _scheme(scheme, "lineitem")
        out[f"lineitem_{scheme}_metrics_summary"] = sql(lc + lp, SUMMARY, recursive=True)
    # 25 classes: 300 pairs, a tree of 24 nodes
    pc, pp = _scheme("ovo", "part")
    out["part_binarize_pair"] = sql(base_ctes("part") + ovo_code(),
                                    "SELECT r.id, r.label, CAST(c.problem AS INTEGER) AS problem, CAST(c.y AS INTEGER) AS y FROM train r JOIN code c ON c.label = r.label")
    out["part_train_ovo"] = sql(pc, _weights_body(", p.pos_label, p.neg_label", " JOIN pairs p ON p.problem = m.problem"), recursive=True)
    out["part_ovo_votes"] = sql(pc + pp, "SELECT id, class, votes FROM votes", recursive=True)
    out["part_score_ovo"] = sql(pc + pp, "SELECT id, label, split, prediction FROM pred", recursive=True)
    pc, pp = _scheme("tree", "part")
    out["part_score_tree"] = sql(pc + pp, "SELECT id, label, split, prediction FROM pred", recursive=True)
    lb, _ = _scheme("ova", "lineitem", Q.ROW_BATCH_PARAMS)
    out["lineitem_train_ova_row_batches"] = sql(lb, _weights_body(", c.label", " JOIN cls c ON c.class_index = m.problem"),
                                             recursive=True)
    out["load_libsvm"] = sql(base, roundtrip_sql(of="src"))
    out["load_labeled_csv"] = sql(base, roundtrip_sql(of="src"))
    out["load_separate_test"] = sql(base, roundtrip_sql("split, ", "src"))
    return out

"""The registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from carthouse.llm import (decontam, exact, kdshard, langid, merkle, minhash, mixing, packing, repair, topk, toxicity,
                           urls, warc)
from carthouse.llm.common import crc32_text, table


def op1_warc(spark, sf_dir):
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    plan = mixing.plan_mix(docs, "doc_id", "text", F.col("source"), mixing.repeating_weights)
    return mixing.taken(plan).withColumnRenamed("id", "doc_id")


def op3_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_text(F.col("doc_id")) % 4 == 2
    model = langid.fit(docs, "text", "lang", "doc_id", F.coalesce(~held_out, F.lit(False)))
    return langid.identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_kd_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return kdshard.kd_shards(docs, 40, {"source": kdshard.category(F.col("source")),
                                        "lang": kdshard.category(F.col("lang")),
                                        "n_chars": F.length("text"), "doc_id": F.col("doc_id")})


def op6_minhash(spark, sf_dir):
    groups = minhash.near_groups(table(spark, sf_dir, "documents"), k=4)
    return groups.select("doc_id", "n_shingles", "component_id",
                         F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_url_filter(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_toxicity(spark, sf_dir):
    held_out = crc32_text(F.col("doc_id")) % 3 == 1
    every, index = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text",
                                "toxic", ~held_out)
    found = toxicity.scores(every, index).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op9_packing(spark, sf_dir):
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10, F.col("id") % 100 == 0)


def op11_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[
        F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    damage = crc32_text(key) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    damaged = rows.select("conv_id", "turn", F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"),
                          text.alias("text"), (damage != 0).alias("present"),
                          F.explode(F.array_repeat(F.lit(0), F.when(damage == 3, 2).otherwise(1))).alias("copy"))
    return repair.repair(damaged, present=F.col("present"))


def op12_decontamination(spark, sf_dir):
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op13_merkle(spark, sf_dir):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
                                  "source", "doc_id", crc32_text(F.col("doc_id")) % 5 == 0, {"text": lowered})


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_kd_shards": op5_kd_shards,
    "op6_minhash": op6_minhash,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_repair": op11_repair,
    "op12_decontamination": op12_decontamination,
    "op13_merkle": op13_merkle,
}

def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(regexp_extract_all({text}, '.'), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return (f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), "
            "lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))")


def _merkle_sql(levels: int, group_levels: int) -> str:
    """Operator 13: ``levels`` levels below and ``group_levels`` above the subroots (16 ** 8 rows, 16 ** 4 sources)."""
    def framed(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def leaf(text):
        return f"sha256({' || '.join([framed(c) for c in ('doc_id', 'source', 'lang', 'n_chars')])} || {framed(text)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"""leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, {leaf('text')} AS d,
           CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS w
           FROM documents)""",
            """numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
           count(*) OVER (PARTITION BY s) AS m FROM leaves)"""]

    def tree(first, name, count):
        """Node tables name0.. with the digests beside each node, each level made from the one before."""
        ctes.append(f"{name}n0 AS ({first})")
        for k in range(count):
            ctes.append(f"""{name}{k} AS MATERIALIZED (SELECT s, i, m, d,
           coalesce(string_agg(d, '') OVER (PARTITION BY s, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(d, '') OVER (PARTITION BY s, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
           FROM {name}n{k})""")
            ctes.append(f"""{name}n{k + 1} AS (SELECT s, i // 16 AS i, CAST(ceil(m / 16) AS BIGINT) AS m,
           CASE WHEN m > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
           FROM {name}{k} GROUP BY s, i // 16, m)""")

    def fold(source, name, count, key, group):
        """Proof text and folded digest of every record, level by level."""
        for k in range(count):
            ctes.append(f"""{name}f{k} AS (SELECT f.* REPLACE (
           CASE WHEN n.m > 1 THEN f.p || n.l || n.r ELSE f.p END AS p,
           CASE WHEN n.m > 1 THEN sha256(n.l || f.w || n.r) ELSE f.w END AS w)
           FROM {source} f JOIN {name}{k} n ON n.s = {group} AND n.i = f.{key} // {16 ** k})""")
            source = f"{name}f{k}"
        return source

    tree("SELECT s, i, m, d FROM numbered", "a", levels)
    tree(f"SELECT 0 AS s, s AS i, count(*) OVER () AS m, d FROM an{levels}", "b", group_levels)
    ctes.append("start AS (SELECT doc_id, s, i, d AS leaf, w, '' AS p FROM numbered)")
    last = fold(fold("start", "a", levels, "i", "f.s"), "b", group_levels, "s", "0")
    return "WITH " + ",\n  ".join(ctes) + f"""
  SELECT f.doc_id, f.leaf, u.d AS subroot, t.d AS root, sha256(f.p) AS proof_sha256, f.w AS folded_root, f.w = t.d AS verified
  FROM {last} f JOIN an{levels} u ON u.s = f.s CROSS JOIN bn{group_levels} t"""


def _repair_sql() -> str:
    """Operator 11 by dynamic programming: a row at a time, the least (cost, audit, lines) in each of four states."""
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"

    def step(s, cost, edit, line=None):
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {f'list_append({s}.t, {line})' if line else s + '.t'}}}"

    def inserted(states):
        """Two layers that add rows inserted behind the given states."""
        return (f"SELECT *, list_min([x2, {', '.join(step(x, 5, 'I', chr(39) + 'user:' + chr(39)) for x in ('x0', 'x1', 'x3'))}]) "
                f"AS y2 FROM ({states})",
                f"x0, x1, y2 AS x2, list_min([x3, {step('y2', 5, 'I', chr(39) + 'assistant:' + chr(39))}]) AS x3")

    def moved(q, kept, renamed, name):
        ways = [step(f"x{q}", 2, "D")]
        for p, initial in kept:
            ways.append(f"CASE WHEN NOT must AND role[1] = '{initial}' THEN {step(f'x{p}', 'pen', 'K', 'line')} ELSE {far} END")
        for p in renamed:
            line = f"'{name}:' || text"
            ways.append(f"CASE WHEN NOT must THEN {step(f'x{p}', '(pen + 1)', 'R', line)} ELSE {far} END")
        return f"list_min([{', '.join(ways)}]) AS x{q}"

    start, out = inserted(f"SELECT cid, n, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} "
                          f"AS x0, {far} AS x1, {far} AS x2, {far} AS x3 FROM convs")
    moves = ", ".join([moved(0, [], [], ""), moved(1, [(0, "s")], [], ""),
                       moved(2, [(0, "u"), (1, "u"), (3, "u")], [0, 1, 3], "user"), moved(3, [(2, "a")], [2], "assistant")])
    more, _ = inserted(f"SELECT w.cid, w.n, f.i, {moves} FROM walk w JOIN f ON f.cid = w.cid AND f.i = w.i + 1")
    key = "coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""
  WITH RECURSIVE names AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS cid
                           FROM (SELECT DISTINCT conv_id FROM conversations)),
  k AS (SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql(key)} % 20 AS k
        FROM conversations c JOIN names n ON c.conv_id IS NOT DISTINCT FROM n.conv_id),
  d AS (SELECT cid, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS nth FROM k WHERE k <> 0),
  e AS (SELECT cid, turn, role, text, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
               regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
  g AS (SELECT *, last = '' AS blank, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again,
               role[1] || lead(role[1]) OVER (PARTITION BY cid ORDER BY i) AS pair FROM e),
  f AS (SELECT *, blank OR again AS must, role || ':' || text AS line, NOT blank AND again AS duplicate,
               NOT blank AND NOT again AND last NOT IN ('.', '!', '?') AS truncated,
               CASE WHEN NOT blank AND NOT again AND last NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS pen FROM g),
  convs AS (SELECT n.cid, count(f.cid) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                   count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM names n LEFT JOIN f ON f.cid = n.cid GROUP BY n.cid),
  walk AS (SELECT cid, n, i, {out} FROM ({start}) UNION ALL SELECT cid, n, i, {out} FROM ({more}) m),
  done AS (SELECT cid, list_min([x0, x3]) AS best FROM walk WHERE i = n)
  SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit,
         sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
  FROM names JOIN convs USING (cid) JOIN done USING (cid)"""


ORACLE_SQL = {
    "op1_warc": """
  WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
             FROM pages),
  w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
  SELECT page_id, payload_bytes, payload_digest,
         CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
         CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN best END AS refers_to
  FROM w""",
    "op3_exact_dedup": r"""
  WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
             FROM documents),
  g AS (SELECT text_sha256, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size
        FROM d GROUP BY text_sha256)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op10_exact_top_k": """
  WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
             FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_decontamination": r"""
  WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS g
          FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
  d AS (SELECT row_number() OVER () AS rid, doc_id,
               coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
  pos AS (SELECT rid, n, i, array_to_string(w[i + 1:i + n], ' ') AS g
          FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS i
                FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
  hit AS (SELECT rid, i, n, item FROM pos JOIN win USING (g, n)),
  words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hit) GROUP BY rid),
  items AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
         coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
  FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)""",
    "op11_repair": _repair_sql(),
    "op13_merkle": _merkle_sql(8, 4),
}

"""SQL of the segmentation, written as relations of cells: what the queries over benchmark items must give."""

from __future__ import annotations

from .params import RELIABILITY


def bases_sql(text: str) -> str:
    return f"upper(regexp_replace(coalesce({text}, ''), '[^ACGTNacgtn]', '', 'g'))"


#: Names that start with a word make its monomer, all names together one more, which is longer than 128 symbols.
MONOMERS = f"""
    names AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS word FROM part),
    m AS (SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS ordinal, name, seq FROM (
        SELECT coalesce(word, 'all names') AS name, {bases_sql("string_agg(p_name, '' ORDER BY p_name)")} AS seq FROM names GROUP BY GROUPING SETS ((word), ())) WHERE seq <> ''),
    s AS (SELECT ordinal AS dp_ordinal, 2 * ordinal AS rank_ordinal, name, seq FROM m
          UNION ALL SELECT CAST(ordinal + n AS INTEGER), 2 * ordinal + 1, name || '''', reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM m, (SELECT count(*) AS n FROM m) c)"""

READS = f"r AS (SELECT item_id AS read_ordinal, CAST(item_id AS VARCHAR) AS read_name, {bases_sql('text')} AS seq FROM benchmark)"


def chunks(part: int, overlap: int) -> str:
    return f"""
    e AS (SELECT *, length(seq) AS n, unnest(range(0, greatest(length(seq), 1), {part})) AS off FROM r),
    c AS (SELECT read_ordinal, CAST(off / {part} AS INTEGER) AS chunk_idx, off, substr(seq, off + 1, {part + overlap}) AS seq FROM e WHERE n > 0 AND (n - off >= {overlap} OR n < {overlap}))"""


def infix(pairs: str) -> str:
    """Rows of cells (pid, i, j, h) of query against substrings of the target, h being the distance less j; then ``near`` (pid, distance)."""
    return f"""
    hw AS (
        SELECT pid, q, t, 0 AS i, CAST(k AS INTEGER) AS j, -CAST(k AS INTEGER) AS h FROM (SELECT *, unnest(range(0, length(t) + 1)) AS k FROM {pairs})
        UNION ALL
        SELECT pid, q, t, i + 1, j, min(CASE WHEN j = 0 THEN h + 1 ELSE least(h + 1, before - CASE WHEN q[i + 1] = t[j] THEN 1 ELSE 0 END) END) OVER (PARTITION BY pid ORDER BY j)
        FROM (SELECT *, lag(h) OVER (PARTITION BY pid ORDER BY j) AS before FROM hw WHERE i < length(q))),
    near AS (SELECT pid, CAST(min(h + j) AS INTEGER) AS distance FROM hw WHERE i = length(q) GROUP BY pid)"""


#: Chunk and strand pairs with their distance.
PAIRED = "cs AS (SELECT row_number() OVER (ORDER BY read_ordinal, chunk_idx, dp_ordinal) AS pid, read_ordinal, chunk_idx, dp_ordinal, s.name, s.seq AS q, c.seq AS t FROM c, s)"
NEAREST = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY read_ordinal, chunk_idx ORDER BY distance, dp_ordinal) AS place FROM cs JOIN near USING (pid)),
    chosen AS (SELECT * FROM ranked WHERE place = 1 OR distance <= {0})"""

EVERY_LANE = "lanes AS (SELECT read_ordinal, chunk_idx, c.seq AS read, dp_ordinal AS j, name, s.seq AS mono FROM c, s)"
CHOSEN_LANES = "lanes AS (SELECT read_ordinal, chunk_idx, t AS read, place AS j, name, q AS mono FROM chosen)"

#: Cells (i, j, k): e is the value less the gaps before k, s the start of the block that a trace from there reaches.
BLOCKS = """
    d AS (
        SELECT read_ordinal, chunk_idx, read, j, mono, 0 AS i, CAST(k AS INTEGER) AS k,
               max(CASE WHEN mono[k + 1] = read[1] THEN 1 ELSE -1 END + CASE WHEN k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY read_ordinal, chunk_idx, j ORDER BY k) AS e, 0 AS s
        FROM (SELECT *, unnest(range(0, length(mono))) AS k FROM lanes)
        UNION ALL
        SELECT read_ordinal, chunk_idx, read, j, mono, i + 1, k, v,
               last_value(CASE WHEN k > 0 AND v = left_v THEN NULL WHEN v = e - 1 THEN s WHEN k > 0 AND v = left_e + 1 + mm THEN left_s ELSE i + 1 END IGNORE NULLS)
                   OVER (PARTITION BY read_ordinal, chunk_idx, j ORDER BY k)
        FROM (SELECT *, lag(v) OVER (PARTITION BY read_ordinal, chunk_idx, j ORDER BY k) AS left_v
              FROM (SELECT *, max(CASE WHEN k = 0 THEN best + mm ELSE greatest(best + mm, left_e + 1 + mm, e - 1) END) OVER (PARTITION BY read_ordinal, chunk_idx, j ORDER BY k) AS v
                    FROM (SELECT *, CASE WHEN mono[k + 1] = read[i + 2] THEN 1 ELSE -1 END AS mm,
                                 lag(e) OVER (PARTITION BY read_ordinal, chunk_idx, j ORDER BY k) AS left_e, lag(s) OVER (PARTITION BY read_ordinal, chunk_idx, j ORDER BY k) AS left_s,
                                 max(CASE WHEN k = length(mono) - 1 THEN e - k END) OVER (PARTITION BY read_ordinal, chunk_idx) AS best
                          FROM d WHERE i + 1 < length(read))))),
    top AS (SELECT read_ordinal, chunk_idx, i, j, s, e - k AS v, length(read) AS n FROM d WHERE k = length(mono) - 1
            QUALIFY row_number() OVER (PARTITION BY read_ordinal, chunk_idx, i ORDER BY e - k DESC, j) = 1),
    tr AS (SELECT * FROM top WHERE i = n - 1
           UNION ALL SELECT top.* FROM tr JOIN top ON top.read_ordinal = tr.read_ordinal AND top.chunk_idx = tr.chunk_idx AND top.i = tr.s - 1),
    b AS (SELECT tr.read_ordinal, tr.chunk_idx, row_number() OVER (PARTITION BY tr.read_ordinal, tr.chunk_idx ORDER BY tr.s) - 1 AS block_idx,
                 lanes.name AS monomer, tr.s + off AS "start", tr.i + off AS "end", tr.v - coalesce(p.v, 0) AS score
          FROM tr JOIN lanes USING (read_ordinal, chunk_idx, j) JOIN c USING (read_ordinal, chunk_idx)
          LEFT JOIN top p ON p.read_ordinal = tr.read_ordinal AND p.chunk_idx = tr.chunk_idx AND p.i = tr.s - 1)"""

#: The fold over a read's blocks, gap and span.
RAW = """
    n AS (SELECT *, row_number() OVER (PARTITION BY read_ordinal ORDER BY chunk_idx, block_idx) - 1 AS p FROM b),
    jump AS (SELECT x.read_ordinal, x.p, min(y.p) AS q FROM n x JOIN n y ON x.read_ordinal = y.read_ordinal AND y.p BETWEEN x.p + 1 AND x.p + 6
             WHERE (x."end" - y."start") * 2 > y."end" - y."start" GROUP BY ALL),
    walk AS (SELECT read_ordinal, p FROM n WHERE p = 0
             UNION ALL SELECT n.read_ordinal, n.p FROM walk w LEFT JOIN jump u ON u.read_ordinal = w.read_ordinal AND u.p = w.p JOIN n ON n.read_ordinal = w.read_ordinal AND n.p = coalesce(u.q + 2, w.p + 1)),
    kept AS (SELECT read_ordinal, p FROM walk UNION ALL SELECT read_ordinal, q + 1 FROM walk JOIN jump USING (read_ordinal, p)),
    raw AS (SELECT read_ordinal, read_name, CAST(row_number() OVER w - 1 AS INTEGER) AS block_idx, monomer, "start", "end", CAST(score AS FLOAT) AS score,
                   "start" - lag("end", 1, 0) OVER w AS gap, "end" - "start" AS span, substr(r.seq, "start" + 1, "end" - "start" + 1) AS segment
            FROM kept JOIN n USING (read_ordinal, p) JOIN r USING (read_ordinal) WINDOW w AS (PARTITION BY read_ordinal ORDER BY p))"""


def homo(seq: str) -> str:
    for c in "ACGTN":
        seq = f"regexp_replace({seq}, '{c}+', '{c}', 'g')"
    return seq


def matched(pairs: str, name: str = "nw") -> str:
    """Cells of the global alignment with the matches of the traced path; then ``{name}_found`` (q, t, d, m)."""
    return f"""
    {name}_pairs AS (SELECT row_number() OVER () AS pid, q, t FROM ({pairs}) WHERE q <> '' AND t <> ''),
    {name} AS (
        SELECT pid, q, t, 0 AS i, CAST(k AS INTEGER) AS j, 0 AS h, 0 AS m FROM (SELECT *, unnest(range(0, length(t) + 1)) AS k FROM {name}_pairs)
        UNION ALL
        SELECT pid, q, t, i + 1, j, v, last_value(CASE WHEN v = h + 1 THEN m WHEN v = left_v THEN NULL ELSE left_m + same END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY j)
        FROM (SELECT *, lag(v) OVER (PARTITION BY pid ORDER BY j) AS left_v
              FROM (SELECT *, min(CASE WHEN j = 0 THEN h + 1 ELSE least(h + 1, left_h - same) END) OVER (PARTITION BY pid ORDER BY j) AS v
                    FROM (SELECT *, CASE WHEN q[i + 1] = t[j] THEN 1 ELSE 0 END AS same, lag(h) OVER (PARTITION BY pid ORDER BY j) AS left_h, lag(m) OVER (PARTITION BY pid ORDER BY j) AS left_m
                          FROM {name} WHERE i < length(q))))),
    {name}_found AS (SELECT q, t, CAST(h + j AS INTEGER) AS d, CAST(m AS INTEGER) AS m FROM {name} WHERE i = length(q) AND j = length(t))"""


def identity(of: str) -> str:
    return f"CAST({of}.m AS DOUBLE) / greatest({of}.m + {of}.d, 1) * 100"


B0, B1, B2 = RELIABILITY

#: Every block with every name's identity, and with all strands' homopolymer identities. No name occurs twice here.
SCORES = (
    matched("SELECT DISTINCT raw.segment AS q, s.seq AS t FROM raw, s")
    + ","
    + matched(f"SELECT DISTINCT {homo('raw.segment')} AS q, {homo('s.seq')} AS t FROM raw, s", "homo")
    + f""",
    scored AS (SELECT raw.*, s.name AS candidate, s.rank_ordinal, {identity('w')} AS idnt,
                      {identity('z')} AS homo_idnt
               FROM raw CROSS JOIN s JOIN nw_found w ON w.q = raw.segment AND w.t = s.seq JOIN homo_found z ON z.q = {homo('raw.segment')} AND z.t = {homo('s.seq')}),
    others AS (SELECT read_ordinal, block_idx, candidate AS second_best, idnt AS second_best_identity FROM scored WHERE candidate <> monomer
               QUALIFY row_number() OVER (PARTITION BY read_ordinal, block_idx ORDER BY idnt DESC, rank_ordinal) = 1),
    homos AS (SELECT read_ordinal, block_idx, candidate, homo_idnt, row_number() OVER (PARTITION BY read_ordinal, block_idx ORDER BY homo_idnt DESC, rank_ordinal) AS place FROM scored),
    final AS (SELECT x.read_ordinal, x.read_name, x.block_idx, monomer, "start", "end", idnt AS identity, second_best, second_best_identity,
                     h1.candidate AS homo_best, h1.homo_idnt AS homo_best_identity, h2.candidate AS homo_second_best, h2.homo_idnt AS homo_second_best_identity,
                     CASE WHEN {B0} + {B1} * idnt + {B2} * (idnt - second_best_identity) > 0 THEN '+' ELSE '?' END AS reliability
              FROM scored x JOIN others o USING (read_ordinal, block_idx)
              JOIN homos h1 ON h1.read_ordinal = x.read_ordinal AND h1.block_idx = x.block_idx AND h1.place = 1
              JOIN homos h2 ON h2.read_ordinal = x.read_ordinal AND h2.block_idx = x.block_idx AND h2.place = 2
              WHERE x.candidate = monomer)"""
)


def traced(pairs: str, first: str, same: str = "q[i + 1] = t[j]", name: str = "al", bottom: str = "bottom") -> str:
    """Cells of an alignment with the operations of the traced path; ``first`` is the row above, less j. Then the last rows."""
    return f"""
    {name} AS (
        SELECT pid, q, t, 0 AS i, CAST(k AS INTEGER) AS j, CAST({first} AS INTEGER) AS h, CASE WHEN '{first}' = '0' THEN repeat('D', k) ELSE '' END AS o, CAST(k AS INTEGER) AS a
        FROM (SELECT *, unnest(range(0, length(t) + 1)) AS k FROM {pairs})
        UNION ALL
        SELECT pid, q, t, i + 1, j, v, own.o || repeat('D', j - own.j), CAST(reach AS INTEGER)
        FROM (SELECT *, min(from_here) OVER (PARTITION BY pid, run ORDER BY j) AS reach,
                     last_value(CASE WHEN v = h + 1 THEN {{'j': j, 'o': o || 'I'}} WHEN v = left_v THEN NULL ELSE {{'j': j, 'o': left_o || CASE WHEN eq = 1 THEN '=' ELSE 'X' END}} END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY j) AS own
              FROM (SELECT *, sum(CASE WHEN v = left_v THEN 0 ELSE 1 END) OVER (PARTITION BY pid ORDER BY j) AS run,
                           least(CASE WHEN v = h + 1 THEN a ELSE 1000000 END, CASE WHEN j > 0 AND v = left_h - eq THEN left_a ELSE 1000000 END) AS from_here
                    FROM (SELECT *, lag(v) OVER (PARTITION BY pid ORDER BY j) AS left_v
                          FROM (SELECT *, min(CASE WHEN j = 0 THEN h + 1 ELSE least(h + 1, left_h - eq) END) OVER (PARTITION BY pid ORDER BY j) AS v
                                FROM (SELECT *, CASE WHEN {same} THEN 1 ELSE 0 END AS eq, lag(h) OVER (PARTITION BY pid ORDER BY j) AS left_h,
                                             lag(o) OVER (PARTITION BY pid ORDER BY j) AS left_o, lag(a) OVER (PARTITION BY pid ORDER BY j) AS left_a
                                      FROM {name} WHERE i < length(q))))))),
    {bottom} AS (SELECT {name}.*, CAST(h + j AS INTEGER) AS d FROM {name} WHERE i = length(q))"""


STRAND_PAIRS = "sp AS (SELECT row_number() OVER (ORDER BY x.dp_ordinal, y.dp_ordinal) AS pid, x.name AS query, y.name AS target, x.seq AS q, y.seq AS t FROM s x, s y)"

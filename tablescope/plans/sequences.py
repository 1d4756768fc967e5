"""2.H17-H20  Sequence diagrams, one per conversation.

Messages: from = role; to = the other side (user <-> assistant, system ->
assistant); type reply for assistant turns; from_type actor for users and
database for the system; from turn 2 on the exchange sits in a
frame ``follow-up`` (loop, alt, par or a plain group by conversation; every seventh turn
stands outside) whose branch is ``early`` (turns 2-3), then ``late``, blank on some turns.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import sequence as SQ
from tablescope.plans import load, register

CONV_SQL = """(SELECT conv_id AS key, turn AS ord, role AS src,
  CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS dst, text AS label,
  CASE WHEN role = 'assistant' THEN 'reply' ELSE 'sync' END AS mtype,
  CASE WHEN turn >= 2 AND turn % 7 <> 5 THEN CASE conv_id % 4 WHEN 0 THEN 'loop:follow-up' WHEN 1 THEN 'alt:follow-up'
       WHEN 2 THEN 'par:follow-up' ELSE 'follow-up' END END AS grp,
  CASE WHEN turn >= 4 AND conv_id % 3 = 0 AND turn % 2 = 0 THEN '' WHEN turn >= 4 THEN 'late' WHEN turn >= 2 THEN 'early' END AS branch,
  CASE WHEN role = 'user' THEN 'actor' WHEN role = 'system' THEN 'database' END AS src_type
FROM conversations)"""


def conv_messages(spark, sf):
    c = load(spark, sf, "conversations")
    c = c.select("conv_id", "turn", "role", "text",
                 F.when(F.col("role") == "user", "assistant").otherwise("user").alias("dst"),
                 F.when(F.col("role") == "assistant", "reply").otherwise("sync").alias("mtype"),
                 F.when((F.col("turn") >= 2) & (F.col("turn") % 7 != 5),
                        F.when(F.col("conv_id") % 4 == 0, "loop:follow-up").when(F.col("conv_id") % 4 == 1, "alt:follow-up")
                        .when(F.col("conv_id") % 4 == 2, "par:follow-up").otherwise("follow-up")).alias("grp"),
                 F.when((F.col("turn") >= 4) & (F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 0), "")
                 .when(F.col("turn") >= 4, "late").when(F.col("turn") >= 2, "early").alias("branch"),
                 F.when(F.col("role") == "user", "actor").when(F.col("role") == "system", "database").alias("src_type"))
    return SQ.messages(c, "role", "dst", "text", "turn", key="conv_id", message_type="mtype", group="grp",
                       branch="branch", from_type="src_type")


@register("tile_sequence", f"""
SELECT key, ord, src, dst, label, mtype, row_number() OVER (PARTITION BY key ORDER BY ord) AS number
FROM {CONV_SQL} WHERE src <> '' AND dst <> ''""")
def tile_sequence(spark, sf):
    return SQ.numbered(conv_messages(spark, sf)).select("key", "ord", "src", "dst", "label", "mtype", "number")


@register("seq_participants", f"""
WITH e AS (SELECT key, ord, 0 AS side, src AS name, src_type AS t FROM {CONV_SQL}
           UNION ALL SELECT key, ord, 1, dst, NULL FROM {CONV_SQL}),
f AS (SELECT key, name, min(ord * 2 + side) AS firstpos,
             arg_min(lower(trim(t)), ord * 2 + side) FILTER (WHERE lower(trim(t)) IN ('actor','database','boundary','participant')) AS ptype
      FROM e WHERE name <> '' GROUP BY key, name)
SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY firstpos) - 1 AS position, ptype FROM f""")
def seq_participants(spark, sf):
    return SQ.participants(conv_messages(spark, sf))


@register("seq_frames", f"""
WITH m AS (SELECT key, ord, grp, nullif(branch, '') AS branch FROM {CONV_SQL} WHERE src <> '' AND dst <> ''),
opening AS (SELECT key, ord, grp, row_number() OVER (PARTITION BY key ORDER BY ord) AS frame_no
            FROM (SELECT *, lag(grp) OVER (PARTITION BY key ORDER BY ord) AS g FROM m) WHERE grp IS NOT NULL AND grp IS DISTINCT FROM g),
inside AS (SELECT m.key, m.ord, m.grp, m.branch, max(o.frame_no) AS frame_no FROM m JOIN opening o ON o.key = m.key AND o.ord <= m.ord
           WHERE m.grp IS NOT NULL GROUP BY m.key, m.ord, m.grp, m.branch),
named AS (SELECT key, frame_no, ord, branch, lag(branch) OVER (PARTITION BY key, frame_no ORDER BY ord) AS pb,
                 first_value(branch) OVER (PARTITION BY key, frame_no ORDER BY ord) AS fb,
                 first_value(ord) OVER (PARTITION BY key, frame_no ORDER BY ord) AS fo FROM inside WHERE branch IS NOT NULL),
heads AS (SELECT key, frame_no, min(ord) AS first_ord, max(ord) AS last_ord, any_value(grp) AS grp FROM inside GROUP BY key, frame_no),
turns AS (SELECT n.key, n.frame_no, count(*) FILTER (WHERE n.ord > h.first_ord AND n.branch IS DISTINCT FROM n.pb) AS c
          FROM named n JOIN heads h ON h.key = n.key AND h.frame_no = n.frame_no GROUP BY n.key, n.frame_no)
SELECT h.key, h.frame_no, CASE WHEN contains(h.grp, ':') THEN split_part(h.grp, ':', 1) ELSE 'group' END AS kind, 'follow-up' AS label,
       h.first_ord, h.last_ord, coalesce(t.c, 0) + 1 AS compartments
FROM heads h LEFT JOIN turns t ON t.key = h.key AND t.frame_no = h.frame_no""")
def seq_frames(spark, sf):
    return SQ.frames(conv_messages(spark, sf))


def _mermaid_sql() -> str:
    mid = ("CASE WHEN regexp_replace(regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'p' "
           "ELSE regexp_replace(regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') END")
    kind = ("CASE WHEN instr(grp, ':') > 1 AND lower(trim(split_part(grp, ':', 1))) IN ('loop', 'opt', 'alt', 'par') "
            "THEN lower(trim(split_part(grp, ':', 1))) ELSE 'group' END")
    flabel = "CASE WHEN instr(grp, ':') > 1 THEN trim(substr(grp, instr(grp, ':') + 1)) ELSE grp END"
    arrow = "CASE mtype WHEN 'sync' THEN '->>' WHEN 'reply' THEN '-->>' WHEN 'async' THEN '-)' WHEN 'lost' THEN '-x' END"
    return rf"""
WITH m AS (SELECT * REPLACE (nullif(branch, '') AS branch) FROM {CONV_SQL} WHERE src <> '' AND dst <> ''),
f AS (SELECT *, lag(grp) OVER w AS prev_grp, CASE WHEN grp IS NOT DISTINCT FROM lag(grp) OVER w THEN 0 ELSE 1 END AS chg
      FROM m WINDOW w AS (PARTITION BY key ORDER BY ord)),
r AS (SELECT *, sum(chg) OVER (PARTITION BY key ORDER BY ord) AS run, {kind} AS kind, {flabel} AS flabel FROM f),
b AS (SELECT *, max(CASE WHEN branch IS NOT NULL OR chg = 1 THEN ord END)
                  OVER (PARTITION BY key, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM r),
c AS (SELECT b.*, x.branch AS cur_branch FROM b LEFT JOIN r x ON x.key = b.key AND x.ord = b.pm),
e AS (SELECT key, ord, 0 AS side, src AS name, src_type AS t FROM m UNION ALL SELECT key, ord, 1, dst, NULL FROM m),
pf AS (SELECT key, name, min(ord * 2 + side) AS firstpos,
              arg_min(lower(trim(t)), ord * 2 + side) FILTER (WHERE lower(trim(t)) IN ('actor','database','boundary','participant')) AS ptype
       FROM e WHERE name <> '' GROUP BY key, name),
ids AS (SELECT key, name, {mid} AS mid, row_number() OVER (PARTITION BY key ORDER BY firstpos) - 1 AS position,
               coalesce(ptype, 'participant') AS pt FROM pf),
lines AS (
  SELECT DISTINCT key, 0 AS sec, 0 AS pos, 0 AS sub, 'sequenceDiagram' AS line FROM m
  UNION ALL SELECT DISTINCT key, 0, 0, 1, '  autonumber' FROM m
  UNION ALL SELECT key, 1, position, 0, '  %% ' || pt FROM ids WHERE pt IN ('database', 'boundary')
  UNION ALL SELECT key, 1, position, 1, '  ' || CASE WHEN pt = 'actor' THEN 'actor' ELSE 'participant' END || ' ' || mid
                   || CASE WHEN mid <> name THEN ' as ' || name ELSE '' END FROM ids
  UNION ALL SELECT key, 2, ord, 0, '  end' FROM c WHERE chg = 1 AND prev_grp IS NOT NULL
  UNION ALL SELECT key, 2, ord, 1, '  ' || CASE WHEN kind = 'group' THEN 'loop' ELSE kind END || ' ' || flabel
            FROM c WHERE chg = 1 AND grp IS NOT NULL
  UNION ALL SELECT key, 2, ord, 2, '  ' || CASE WHEN kind = 'par' THEN 'and' ELSE 'else' END || ' ' || branch
            FROM c WHERE kind IN ('alt', 'par') AND grp IS NOT NULL AND chg = 0 AND branch IS NOT NULL AND branch IS DISTINCT FROM cur_branch
  UNION ALL SELECT c.key, 2, c.ord, 3, CASE WHEN c.grp IS NOT NULL THEN '    ' ELSE '  ' END || s.mid || ({arrow.replace('mtype', 'c.mtype')})
                   || d.mid || ': ' || regexp_replace(c.label, '\s*\n\s*', ' ', 'g')
            FROM c JOIN ids s ON s.key = c.key AND s.name = c.src JOIN ids d ON d.key = c.key AND d.name = c.dst
  UNION ALL SELECT key, 3, 0, 0, '  end' FROM (SELECT key, grp FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC) = 1)
            WHERE grp IS NOT NULL)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY sec, pos, sub) AS line_no, line FROM lines"""


@register("seq_mermaid", _mermaid_sql())
def seq_mermaid(spark, sf):
    """One row per document line; also checked against a line-by-line Python
    rendering of the same rules in tests/."""
    return SQ.mermaid_lines(conv_messages(spark, sf), autonumber=True)


@register("seq_mermaid_documents", f"""
SELECT key, (line_no - 1) // 8 AS page, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS document
FROM ({_mermaid_sql()}) GROUP BY key, (line_no - 1) // 8""")
def seq_mermaid_documents(spark, sf):
    """The documents' texts, in pages of 8 lines here, so that most have several."""
    return SQ.mermaid_documents(SQ.mermaid_lines(conv_messages(spark, sf), autonumber=True), page_lines=8)

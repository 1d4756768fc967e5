"""Sequence-diagram tile data (2.H17-H20).

Rows are messages in an explicit order column, optionally split into diagrams
by a key.  All per-diagram ordering (numbering, first appearance, group
frames) uses the skew-safe ordered scan -- a huge diagram is spread over
several tasks, never held by one.

* messages: type in sync/reply/async/lost (blank or unknown -> sync),
  autonumber per diagram;
* participants: first appearance (``from`` before ``to``); type = the first
  valid type seen for the name (actor, database, boundary, participant);
* frames: contiguous equal ``group`` values form one frame; ``kind:label``
  with kind in loop/opt/alt/par, else kind ``group`` with the whole value as
  label; a branch change inside a frame opens a new compartment;
* mermaid: a ``sequenceDiagram`` document, one row per line.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.filters import col
from tablescope.operators.ordered import LAYOUT, lay_out, ordered_scan

# Fixed vocabularies and arrow syntax (same as the reference's renderer):
PARTICIPANT_TYPES = ["actor", "database", "boundary", "participant"]
MESSAGE_TYPES = ["sync", "reply", "async", "lost"]
FRAME_KINDS = ["loop", "opt", "alt", "par"]
ARROWS = {"sync": "->>", "reply": "-->>", "async": "-)", "lost": "-x"}


def _txt(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _msg_type(c: Column | None) -> Column:
    if c is None:
        return F.lit("sync")
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(MESSAGE_TYPES), t).otherwise(F.lit("sync"))


def messages(df: DataFrame, frm: str, to: str, label: str, order: str, key: str | None = None,
             message_type: str | None = None, group: str | None = None, branch: str | None = None,
             from_type: str | None = None, to_type: str | None = None) -> DataFrame:
    """Normalised messages: (key, ord, src, dst, label, mtype, grp, branch, src_type, dst_type, valid)."""
    opt = lambda c: col(c).cast("string") if c else F.lit(None).cast("string")
    g = F.trim(opt(group))
    return df.select((col(key) if key else F.lit(0)).alias("key"), col(order).alias("ord"),
                     _txt(col(frm)).alias("src"), _txt(col(to)).alias("dst"), _txt(col(label)).alias("label"),
                     _msg_type(col(message_type) if message_type else None).alias("mtype"),
                     F.when(g != "", g).alias("grp"), opt(branch).alias("branch"),
                     opt(from_type).alias("src_type"), opt(to_type).alias("dst_type"))


def numbered(msgs: DataFrame) -> DataFrame:
    """Autonumber: 1.. per diagram over messages with both endpoints."""
    valid = msgs.where((F.col("src") != "") & (F.col("dst") != "")).withColumn("one", F.lit(1))
    return ordered_scan(valid, ["key"], ["ord"], sums=["one"]).withColumnRenamed("cum_one", "number").drop("one")


def participants(msgs: DataFrame) -> DataFrame:
    """(key, name, position, ptype): first appearance order (from before to)."""
    ends = msgs.select("key", "ord", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("src").alias("name"), F.col("src_type").alias("t")),
        F.struct(F.lit(1).alias("side"), F.col("dst").alias("name"), F.col("dst_type").alias("t")))).alias("p")) \
        .select("key", "ord", "p.*").where(F.col("name") != "")
    tnorm = F.lower(F.trim(F.col("t")))
    first = ends.groupBy("key", "name").agg(
        F.min(F.struct("ord", "side")).alias("first"),
        F.min(F.when(tnorm.isin(PARTICIPANT_TYPES), F.struct("ord", "side", tnorm.alias("tt")))).alias("ft"))
    ranked = ordered_scan(first.select("key", "name", F.col("first.ord").alias("o"), F.col("first.side").alias("sd"),
                                       F.col("ft.tt").alias("ptype"), F.lit(1).alias("one")),
                          ["key"], ["o", "sd"], sums=["one"])
    return ranked.select("key", "name", (F.col("cum_one") - 1).alias("position"), "ptype")


def _frame_parts(grp: Column):
    i = F.instr(grp, ":")
    kind = F.lower(F.trim(F.substring_index(grp, ":", 1)))
    has_kind = i > 1
    k = F.when(has_kind & kind.isin(FRAME_KINDS), kind).otherwise(F.lit("group"))
    lbl = F.when(has_kind, F.trim(F.expr("substring(grp, instr(grp, ':') + 1)"))).otherwise(grp)
    return k, lbl


def framed(msgs: DataFrame) -> DataFrame:
    """Per valid message: frame boundaries and compartment changes.

    Adds frame_no (1.. per diagram, counting group frames), opens (a frame opens
    at this row), closes_prev (the previous frame ends before this row),
    new_branch (a compartment starts here), kind and frame_label."""
    valid = msgs.where((F.col("src") != "") & (F.col("dst") != ""))
    valid = valid.withColumn("branch", F.when(F.col("branch") != "", F.col("branch")))   # a blank branch is none
    s1 = ordered_scan(lay_out(valid, ["key"], ["ord"]), ["key"], ["ord"], lags=["grp"])
    changed = ~F.col("grp").eqNullSafe(F.col("prev_grp"))
    s1 = s1.withColumn("chg", changed.cast("long")).withColumn("opened", (changed & F.col("grp").isNotNull()).cast("long"))
    # the last non-null branch before this row; the opening row of a run counts even with a
    # NULL branch, so inside a run nothing of an earlier one is seen
    s1 = s1.withColumn("said", F.when(F.col("branch").isNotNull() | (F.col("chg") == 1), F.struct("ord", "branch")))
    s2 = (ordered_scan(s1, ["key"], ["ord"], sums=["chg", "opened"], prior_max=["said"])
          .withColumnsRenamed({"cum_chg": "run", "cum_opened": "frame_no"}))
    s2 = s2.withColumn("cur_branch", F.col("pmax_said.branch")).drop("said", "pmax_said", *LAYOUT)
    kind, lbl = _frame_parts(F.col("grp"))
    return s2.select(
        "*", kind.alias("kind"), lbl.alias("frame_label"),
        ((F.col("chg") == 1) & F.col("grp").isNotNull()).alias("opens"),
        ((F.col("chg") == 1) & F.col("prev_grp").isNotNull()).alias("closes_prev"),
        (F.col("grp").isNotNull() & (F.col("chg") == 0) & F.col("branch").isNotNull()
         & ~F.col("branch").eqNullSafe(F.col("cur_branch"))).alias("new_branch"))


def frames(msgs: DataFrame) -> DataFrame:
    """(key, frame_no, kind, label, first_ord, last_ord, compartments)."""
    f = framed(msgs).where(F.col("grp").isNotNull())
    return (f.groupBy("key", "frame_no").agg(F.first("kind").alias("kind"), F.first("frame_label").alias("label"),
                                        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
                                             (F.count_if("new_branch") + 1).alias("compartments")))


def mermaid_id(name: Column) -> Column:
    i = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"), r"^_+|_+$", "")
    return F.when(i == "", F.lit("p")).otherwise(i)


def mermaid_lines(msgs: DataFrame, autonumber: bool = False) -> DataFrame:
    """(key, line_no, line): the mermaid ``sequenceDiagram`` document per diagram,
    one row per line (join with ``array_join`` per key for the text)."""
    parts = participants(msgs)
    pid = mermaid_id(F.col("name"))
    ptype = F.coalesce(F.col("ptype"), F.lit("participant"))
    decl = F.concat(F.lit("  "), F.when(ptype == "actor", F.lit("actor")).otherwise(F.lit("participant")), F.lit(" "), pid,
                    F.when(pid != F.col("name"), F.concat(F.lit(" as "), F.col("name"))).otherwise(F.lit("")))
    head_lines = parts.select("key", F.lit(1).alias("sec"), F.col("position").cast("long").alias("pos"), F.explode(F.array(
        F.struct(F.lit(0).alias("sub"), F.when(ptype == "database", F.lit("  %% database"))
                 .when(ptype == "boundary", F.lit("  %% boundary")).alias("line")),
        F.struct(F.lit(1).alias("sub"), decl.alias("line")))).alias("l")).select("key", "sec", "pos", "l.*")
    keys = msgs.select("key").distinct()
    top = [F.struct(F.lit(0).alias("sub"), F.lit("sequenceDiagram").alias("line"))]
    if autonumber:
        top.append(F.struct(F.lit(1).alias("sub"), F.lit("  autonumber").alias("line")))
    top_lines = keys.select("key", F.lit(0).alias("sec"), F.lit(0).cast("long").alias("pos"),
                            F.explode(F.array(*top)).alias("l")).select("key", "sec", "pos", "l.*")
    f = framed(msgs)
    ids = parts.select("key", "name", pid.alias("mid"))
    f = (f.join(ids.select("key", F.col("name").alias("src"), F.col("mid").alias("src_id")), ["key", "src"], "left")
          .join(ids.select("key", F.col("name").alias("dst"), F.col("mid").alias("dst_id")), ["key", "dst"], "left"))
    arrow = F.create_map(*[F.lit(x) for kv in ARROWS.items() for x in kv])[F.col("mtype")]
    open_kind = F.when(F.col("kind") == "group", F.lit("loop")).otherwise(F.col("kind"))
    indent = F.when(F.col("grp").isNotNull(), F.lit("    ")).otherwise(F.lit("  "))
    text = F.regexp_replace(F.col("label"), r"\s*\n\s*", " ")
    msg = F.concat(indent, F.col("src_id"), arrow, F.col("dst_id"), F.lit(": "), text)
    body = f.select("key", F.lit(2).alias("sec"), F.col("ord").cast("long").alias("pos"), F.explode(F.array(
        F.struct(F.lit(0).alias("sub"), F.when(F.col("closes_prev"), F.lit("  end")).alias("line")),
        F.struct(F.lit(1).alias("sub"), F.when(F.col("opens"), F.concat(F.lit("  "), open_kind, F.lit(" "), F.col("frame_label"))).alias("line")),
        F.struct(F.lit(2).alias("sub"), F.when(F.col("new_branch"), F.concat(
            F.lit("  "), F.when(F.col("kind") == "par", F.lit("and")).when(F.col("kind") == "alt", F.lit("else")),   # null elsewhere: no line
            F.lit(" "), F.col("branch"))).alias("line")),
        F.struct(F.lit(3).alias("sub"), msg.alias("line")))).alias("l")).select("key", "sec", "pos", "l.*")
    # the frame still open after the last message closes at the end
    last = (f.groupBy("key").agg(F.max_by("grp", "ord").alias("g_last"))
            .where(F.col("g_last").isNotNull())
            .select("key", F.lit(3).alias("sec"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("sub"), F.lit("  end").alias("line")))
    lines = top_lines.unionByName(head_lines).unionByName(body).unionByName(last).where(F.col("line").isNotNull())
    numbered_lines = ordered_scan(lines.withColumn("one", F.lit(1)), ["key"], ["sec", "pos", "sub"], sums=["one"])
    return numbered_lines.select("key", F.col("cum_one").alias("line_no"), "line")


#: lines of one page of a document
PAGE_LINES = 10_000


def mermaid_documents(lines: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """(key, page, document): the text of each diagram in pages of ``page_lines`` lines, from page 0; a shorter
    diagram is one page, and the pages of a longer one joined are its document.  No
    group is larger than a page, however long a diagram is."""
    page = F.floor((F.col("line_no") - 1) / F.lit(page_lines)).cast("long").alias("page")
    return (lines.groupBy("key", page).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
            .select("key", "page", F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n")).alias("document")))

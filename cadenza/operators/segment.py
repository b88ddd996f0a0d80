"""Segmentation of ordered rows: sessions, chunks, windows, chapters, cues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.cuts import open_segments
from cadenza.operators.fold import fold_small
from cadenza.operators.intervals import asof, nearest_within, point_join
from cadenza.operators.ordered import BLOCK, carried, lag, last_value, lead, ordered_blocks, row_index, run_sum, running
from cadenza.session import materialize

INF = float("inf")


def _numbered(opened: DataFrame, key, order, name: str, flag: str = "opens") -> DataFrame:
    one = opened.withColumn("_one", F.col(flag).cast("long"))
    return carried(one, key, order, {name: run_sum("_one")}).withColumn(name, F.col(name) - 1).drop("_one", BLOCK)


def sessionize(words: DataFrame, gap: float = 0.75, max_span: float | None = 20.0, key=("source_id",), order=("start", "pos")) -> DataFrame:
    """Add ``session``: a new one on a pause of at least ``gap`` or once the span reaches ``max_span``."""
    key, order = list(key), list(order)
    b = ordered_blocks(words, key, order)
    r = carried(b, key, order, {"_pe": lag("end")})
    brk = F.round(F.col("start") - F.col("_pe"), 9) >= gap
    if max_span is None:
        r = r.withColumn("opens", F.coalesce(brk, F.lit(True)))
    else:
        v = F.when(brk, F.lit(INF)).otherwise(F.round(F.col("end") - max_span, 9))
        return open_segments(r, key, order, v=v, b=F.col("start"), blocked=True, number="session").drop("_pe", "opens", BLOCK)
    return _numbered(r, key, order, "session").drop("_pe", "opens")


def session_table(sessions: DataFrame, text: bool = False) -> DataFrame:
    aggs = [F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_words")]
    if text:
        words = F.sort_array(F.collect_list(F.struct("pos", "word")))
        aggs.append(F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("text"))
    return sessions.groupBy("source_id", "session").agg(*aggs)


def budget_chunks(
    segs: DataFrame, *, size: Column, budget: float, overlap: float, at_least_one: bool, key=("source_id",), order=("start", "sent")
) -> DataFrame:
    """Chunks of whole segments within a budget; the tail of a chunk, up to ``overlap``, opens the next.

    Returns one row per (chunk, segment). A chunk's base is the amount of text before its first
    row, overlap included, so the rule is a threshold on running sums. ``at_least_one`` keeps the last
    segment as overlap even when it alone exceeds it. Segments must not exceed ``budget - overlap``
    for the token rule (see :func:`split_long`).
    """
    key, order = list(key), list(order)
    b = ordered_blocks(segs.withColumn("_size", size.cast("double")), key, order)
    r = carried(b, key, order, {"_before": run_sum("_size", inclusive=False), "_prev": lag("_size")})
    r = r.withColumn("_rid", F.struct(*order))
    if overlap > 0:
        # base after a break at this row: the first earlier row whose text still fits the overlap
        look = r.select(*key, *order, (F.col("_before") - overlap).alias("_want"), F.xxhash64(*key, *order).alias("_pid"))
        at = asof(look, r.select(*key, "_before"), key, "_want", "_before", id="_pid")
        tail = at.select(*key, *order, F.col("next_at").alias("_tail"))
        r = r.join(tail, [*key, *order])
        floor_row = F.col("_before") - F.coalesce("_prev", F.lit(0.0))
        base = F.least("_tail", F.col("_before"))
        if at_least_one:
            base = F.least(base, floor_row)
    else:
        base = F.col("_before")
    r = r.withColumn("_base", base).drop("_rid")
    opened = open_segments(r, key, order, v_strict=F.col("_before") + F.col("_size") - budget, b=F.col("_base"), blocked=True, number="chunk")
    # written once: the marking pass would run for every branch
    n = materialize(opened.drop("_prev", "_tail", BLOCK))
    own = n.drop("opens")
    # rows repeated as overlap: between a chunk's base and its break; after short chunks they reach back over several
    spans = n.filter(F.col("opens") & (F.col("_base") < F.col("_before"))).select(*key, "chunk", F.col("_base").alias("_nb"), F.col("_before").alias("_ob"))
    again = point_join(own.drop("chunk"), spans, key, "_before", ("_nb", "_ob"), width=max(2.0 * overlap, 1.0), levels=3).filter(F.col("_before") < F.col("_ob"))
    return own.unionByName(again.drop("_nb", "_ob")).drop("_before", "_base")


def chunk_table(rows: DataFrame, key=("source_id",)) -> DataFrame:
    return rows.groupBy(*key, "chunk").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_segments"), F.sum("_size").alias("size")
    )


def chunk_by_tokens(
    segs: DataFrame, *, tokens: Column | None = None, threshold: float, window: float, overlap: float, key=("source_id",), order=("start", "sent"), text: str | None = None
) -> DataFrame:
    """One chunk for a source within ``threshold``; else windows of ``window`` tokens stepping back ``overlap``.

    With ``text``, segments of more than ``window - overlap`` tokens are split by words first (``piece_no``, ``piece``; their times go
    on in proportion to the words), and tokens are estimated from the pieces.
    """
    key, order = list(key), list(order)
    if text is not None:
        per_word = lambda w: F.ceil((F.length(w) + 1) / 4.0).cast("int")  # noqa: E731  a word and the space behind it
        s = split_long(segs, text, int(window - overlap), per_word, bounds=True)
        length, n = F.col("end") - F.col("start"), F.greatest(F.col("piece_of"), F.lit(1))
        cut = F.col("piece_of") > 0
        s = s.withColumns(
            {
                "_s": F.when(cut, F.round(F.col("start") + length * F.col("piece_lo") / n, 6)).otherwise(F.col("start")),
                "end": F.when(cut, F.round(F.col("start") + length * F.col("piece_hi") / n, 6)).otherwise(F.col("end")),
            }
        )
        segs = s.withColumn("start", F.col("_s")).drop("_s", "piece_lo", "piece_hi", "piece_of")
        order, tokens = [*order, "piece_no"], F.ceil(F.length("piece") / 4.0)
    s = segs.withColumn("_tok", tokens)
    total = s.groupBy(*key).agg(F.sum("_tok").alias("_total"))
    s = s.join(total, key)
    small = s.filter(F.col("_total") <= threshold).withColumns({"_size": F.col("_tok").cast("double"), "chunk": F.lit(0).cast("long")})
    large = budget_chunks(s.filter(F.col("_total") > threshold), size=F.col("_tok"), budget=window, overlap=overlap, at_least_one=False, key=key, order=order)
    return small.unionByName(large).drop("_tok", "_total")


def split_long(df: DataFrame, text: str, limit: int, token_count=None, bounds: bool = False) -> DataFrame:
    """Texts above ``limit`` tokens become pieces of whole words; others stay one piece (``piece_no``, ``piece``).

    With ``bounds``, also the words before a piece and up to its end, and of the whole text (``piece_lo, piece_hi, piece_of``).

    ``token_count`` maps a word column to its tokens (default: a quarter of its characters, rounded up).
    """
    count = token_count or (lambda w: F.ceil(F.length(w) / 4.0).cast("int"))
    words = F.filter(F.split(F.col(text), "[ \n\t\r]+"), lambda w: w != "")
    zero = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("done"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("tok"))

    def step(a, w):
        t = count(w)
        full = (a["hi"] > a["lo"]) & (a["tok"] + t > limit)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))).otherwise(a["done"]).alias("done"),
            F.when(full, a["hi"]).otherwise(a["lo"]).alias("lo"),
            (a["hi"] + 1).alias("hi"),
            F.when(full, t).otherwise(a["tok"] + t).alias("tok"),
        )

    d = df.withColumn("_w", words)
    spans = F.aggregate("_w", zero, step, lambda a: F.concat(a["done"], F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))))
    d = d.withColumn("_s", spans).select("*", F.posexplode("_s").alias("piece_no", "_p"))
    piece = F.array_join(F.slice("_w", F.col("_p.lo") + 1, F.greatest(F.lit(0), F.col("_p.hi") - F.col("_p.lo"))), " ")
    d = d.withColumn("piece", piece)
    if bounds:
        d = d.withColumns({"piece_lo": F.col("_p.lo"), "piece_hi": F.col("_p.hi"), "piece_of": F.size("_w")})
    return d.drop("_w", "_s", "_p")


def time_windows(segs: DataFrame, length: float = 45.0, gap: float = 2.0, key=("source_id",), order=("start", "sent")) -> DataFrame:
    """Add ``win``: closed once ``length`` seconds passed since its start or a gap above ``gap`` comes."""
    key, order = list(key), list(order)
    b = ordered_blocks(segs, key, order)
    r = carried(b, key, order, {"_pe": lag("end")})
    v = F.when(F.round(F.col("start") - F.col("_pe"), 9) > gap, F.lit(INF)).otherwise(F.round(F.col("start") - length, 9))
    return open_segments(r, key, order, v=v, b=F.col("start"), blocked=True, number="win").drop("_pe", "opens", BLOCK)


def semantic_chunks(segs: DataFrame, *, sim: str, threshold: float, min_len: float, target: float, key=("source_id",), order=("start", "sent")) -> DataFrame:
    """Add ``chunk``: cut behind a row of low similarity once ``min_len`` is reached, or at 1.5 * ``target``.

    ``sim`` is the similarity with the next row.
    """
    key, order = list(key), list(order)
    b = ordered_blocks(segs, key, order)
    r = carried(b, key, order, {"_pe": lag("end"), "_ps": lag(sim)})
    need = F.when(F.col("_ps") < threshold, F.least(F.lit(min_len), F.lit(target * 1.5))).otherwise(F.lit(target * 1.5))
    v = F.round(F.col("_pe") - need, 9)
    return open_segments(r, key, order, v=v, b=F.col("start"), blocked=True, number="chunk").drop("_pe", "_ps", "opens", BLOCK)


def dedup_close_starts(df: DataFrame, tol: float = 2.0, key=("source_id",), start="start", id="id") -> DataFrame:
    """Keep a row when its start lies at least ``tol`` after the last kept one."""
    o = open_segments(df, list(key), [start, id], v=F.round(F.col(start) - tol, 9), b=F.col(start))
    return o.filter("opens").drop("opens", BLOCK)


def non_overlapping(df: DataFrame, key, start: str, end: str, id: str) -> DataFrame:
    """Keep the earliest; drop rows that start before the last kept one ends."""
    o = open_segments(df, list(key), [start, id], v=F.col(start), b=F.col(end))
    return o.filter("opens").drop("opens", BLOCK)


def min_interval_pick(df: DataFrame, key, t: str, id: str, *, nth: int, min_sec: float) -> DataFrame:
    """Every ``nth`` row of the key, at least ``min_sec`` after the last picked one."""
    r = running(df, list(key), [t, id], {"_i": row_index()}).filter((F.col("_i") - 1) % nth == 0).drop("_i")
    o = open_segments(r, list(key), [t, id], v=F.round(F.col(t) - min_sec, 9), b=F.col(t))
    return o.filter("opens").drop("opens", BLOCK)


def peaks(points: DataFrame, key, t: str, value: str, id: str, *, refractory: int = 5, min_rows: int = 10, digits: int = 3) -> DataFrame:
    """Values above mean + half a deviation and both neighbours, ``refractory`` samples apart; with prominence."""
    key = list(key)
    s = points.groupBy(*key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    r = running(points, key, [t, id], {"_p": lag(value), "_nx": lead(value), "_i": row_index()})
    r = r.join(s, key).withColumn("_thr", F.col("_m") + 0.5 * F.col("_s"))
    c = r.filter((F.col(value) > F.col("_thr")) & (F.col(value) > F.col("_p")) & (F.col(value) > F.col("_nx")))
    o = open_segments(c, key, ["_i"], v=F.col("_i") - refractory, b=F.col("_i")).filter("opens")
    prom = F.least(F.lit(1.0), (F.col(value) - F.col("_thr")) / F.greatest("_s", F.lit(1.0)))
    return o.withColumn("prominence", F.round(prom, digits)).drop("opens", BLOCK, "_m", "_s", "_n", "_p", "_nx", "_i", "_thr")


def phrase_match(words: DataFrame, rules: Sequence[tuple[str, str, int]], key=("source_id",), order=("start", "pos")) -> DataFrame:
    """Words taken by filler rules (name, pattern, word count): ``start, end, rule`` per match.

    Multi-word rules match leftmost first and consume their words; single-word rules see the rest.
    """
    key, order = list(key), list(order)
    multi = [r for r in rules if r[2] > 1]
    single = [r for r in rules if r[2] == 1]
    longest = max([r[2] for r in multi], default=1)
    b = ordered_blocks(words, key, order)
    runs = {"_i": row_index()}
    t = carried(b, key, order, runs)
    # n-grams by repeated look-ahead over the same blocks
    t = t.withColumns({"_w1": F.col("word"), "_e1": F.col("end")})
    for k in range(2, longest + 1):
        t = carried(t, key, order, {f"_w{k}": lead(f"_w{k - 1}"), f"_e{k}": lead(f"_e{k - 1}")})
    hit_name, hit_len, hit_end = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("double")
    for name, pattern, n in reversed(multi):
        gram = F.lower(F.trim(F.concat_ws(" ", *[F.col(f"_w{k}") for k in range(1, n + 1)])))
        ok = F.col(f"_w{n}").isNotNull() & gram.rlike(pattern)
        hit_name = F.when(ok, name).otherwise(hit_name)
        hit_len = F.when(ok, n).otherwise(hit_len)
        hit_end = F.when(ok, F.col(f"_e{n}")).otherwise(hit_end)
    t = t.withColumns({"_hn": hit_name, "_hl": hit_len, "_he": hit_end})
    # a match at i blocks matches before i + length; other rows neither open nor close anything
    m = open_segments(t.filter("_hl is not null"), key, ["_i"], v=F.col("_i"), b=F.col("_i") + F.col("_hl")).filter("opens")
    m = m.select(*key, "_i", "start", F.col("_he").alias("end"), F.col("_hn").alias("rule"), "_hl")
    used = m.select(*key, F.explode(F.sequence(F.col("_i"), F.col("_i") + F.col("_hl") - 1)).alias("_i"))
    one = F.lit(None).cast("string")
    low = F.lower(F.trim(F.col("word")))
    for name, pattern, _ in reversed(single):
        one = F.when(low.rlike(pattern), name).otherwise(one)
    rest = t.withColumn("rule", one).filter("rule is not null").join(used, [*key, "_i"], "left_anti")
    return m.select(*key, "start", "end", "rule").unionByName(rest.select(*key, "start", "end", "rule"))


# Lengths of assembled plans and roles that close a thought.
PLAN_MIN, PLAN_MAX, SPLIT_AT, PLAN_TARGET = 45.0, 80.0, 45.0, 62.0
CLOSING_ROLES = ("peak", "payoff")


def split_arcs(segs: DataFrame, key=("source_id", "arc_no"), order=("seg_no",)) -> DataFrame:
    """Add ``grp``: a hook after other roles, an act change once 45 s are filled, or an overflow of 80 s opens a group."""
    key, order = list(key), list(order)
    b = ordered_blocks(segs, key, order)
    r = carried(b, key, order, {"_before": run_sum("dur", inclusive=False)})
    other = F.when(F.col("role") != "hook", F.col("_before"))
    r = r.withColumn("_other", other)
    r = carried(r, key, order, {"_lo": last_value("_other", inclusive=False)})
    hook = F.when(F.col("role") == "hook", F.col("_lo"))
    act = F.when(
        F.col("role").isin("peak", "payoff", "hook") & F.col("_lo").isNotNull(), F.least("_lo", F.round(F.col("_before") - SPLIT_AT, 9))
    )
    o = open_segments(
        r, key, order, v=F.greatest(hook, act), v_strict=F.round(F.col("_before") + F.col("dur") - PLAN_MAX, 9), b=F.col("_before"), blocked=True
    )
    return _numbered(o, key, order, "grp").drop("_before", "_other", "_lo", "opens")


def merge_groups(segs: DataFrame, key=("source_id", "arc_no"), *, target=PLAN_TARGET, strength="soft", keep_short_arcs=True) -> DataFrame:
    """Merge neighbouring groups of an arc into plans: (key, plan_no, first_seg, last_seg, dur).

    Passes: up to 45 s (short but complete arcs stay); until a closing role; thin arcs up to ``target``; a
    short last group joins its left neighbour. A plan never exceeds 80 s. An arc's groups are few, so they
    travel as one array.
    """
    key = list(key)
    g = segs.groupBy(*key, "grp").agg(
        F.min("seg_no").alias("i0"),
        F.max("seg_no").alias("i1"),
        F.sum("dur").alias("dur"),
        F.count(F.when(F.col("role") == "development", 1)).alias("dev"),
        F.max(F.col("role").isin("hook", "setup")).alias("opening"),
        F.max_by(F.col("role").isin(*CLOSING_ROLES), "seg_no").alias("closing"),
    )
    fields = ["i0", "i1", "dur", "dev", "opening", "closing"]
    arr = F.transform(
        F.sort_array(F.collect_list(F.struct("grp", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])
    )
    t = "array<struct<i0:bigint,i1:bigint,dur:double,dev:bigint,opening:boolean,closing:boolean>>"

    def join(a, x):
        return F.struct(
            a["i0"].alias("i0"), x["i1"].alias("i1"), (a["dur"] + x["dur"]).alias("dur"), (a["dev"] + x["dev"]).alias("dev"),
            (a["opening"] | x["opening"]).alias("opening"), x["closing"].alias("closing"),
        )

    def one_pass(groups: Column, wants) -> Column:
        def step(acc, x):
            cur = F.try_element_at(acc, F.lit(-1))
            on = (F.size(acc) > 0) & wants(cur) & (F.round(cur["dur"] + x["dur"], 9) <= PLAN_MAX)
            return F.when(on, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(join(cur, x)))).otherwise(F.concat(acc, F.array(x)))

        return F.aggregate(groups, F.array().cast(t), step)

    def short(c):
        complete = c["opening"] & c["closing"] & (F.round(c["dur"], 9) >= PLAN_MIN * 0.6)
        return (F.round(c["dur"], 9) < PLAN_MIN) & (~complete if keep_short_arcs else F.lit(True))

    out = g.groupBy(*key).agg(arr.cast(t).alias("_g"))
    out = out.withColumn("_g", F.filter(F.coalesce("_g", F.array().cast(t)), lambda x: x.isNotNull()))
    out = out.withColumn("_p", one_pass(F.col("_g"), short))
    out = out.withColumn("_p", one_pass(F.col("_p"), lambda c: ~c["closing"]))
    if strength != "off":
        thin = (lambda c: c["dev"] < 2) if strength == "soft" else (lambda c: F.lit(True))
        out = out.withColumn("_p", one_pass(F.col("_p"), lambda c: (F.round(c["dur"], 9) < target) & thin(c)))
    last, prev = F.try_element_at("_p", F.lit(-1)), F.try_element_at("_p", F.lit(-2))
    tail = (F.size("_p") >= 2) & (F.round(last["dur"], 9) < PLAN_MIN) & (F.round(prev["dur"] + last["dur"], 9) <= PLAN_MAX)
    out = out.withColumn("_p", F.when(tail, F.concat(F.slice("_p", F.lit(1), F.size("_p") - 2), F.array(join(prev, last)))).otherwise(F.col("_p")))
    return out.select(*key, F.posexplode("_p").alias("plan_no", "_x")).select(
        *key, "plan_no", F.col("_x.i0").alias("first_seg"), F.col("_x.i1").alias("last_seg"), F.col("_x.dur").alias("dur")
    )


def audio_offsets(cuts: DataFrame, key, order: str = "cut_no", *, max_offset=0.4, min_offset=0.08, duration: float | None = None, every: bool = False) -> DataFrame:
    """Shifted audio bounds of the cuts of a plan: (key, cut_no, a_start, a_end).

    Two development/peak-like changes pull the next sound forward (J), other role changes let it run on (L); with ``every``, the sound
    runs on at all transitions, whatever the roles. The
    room left depends on the shift before, so a plan's few cuts are folded in order.
    """
    key = list(key)
    t = "array<struct<cut_no:bigint,role:string,s:double,e:double,d:double>>"
    rows = cuts.select(*key, F.col(order).cast("long").alias("cut_no"), "role", "c_start", "c_end")

    def step(acc, x):
        cur = F.try_element_at(acc, F.lit(-1))
        new = F.struct(x["cut_no"].alias("cut_no"), x["role"].alias("role"), x["c_start"].alias("s"), x["c_end"].alias("e"), (x["c_end"] - x["c_start"]).alias("d"))
        pair = F.concat_ws(">", cur["role"], new["role"])
        hard = F.lit(False) if every else (cur["role"] == new["role"]) | (cur["role"] == "") | (new["role"] == "")
        j = F.lit(False) if every else pair.isin("development>peak", "hook>peak")
        cap = F.least(F.lit(max_offset), cur["d"] * 0.2, new["d"] * 0.2)
        room_l = F.greatest(F.lit(0.0), (F.lit(duration) - cur["e"]) if duration is not None else cap)
        off_l = F.least(cap, room_l, F.greatest(F.lit(0.0), new["e"] - new["s"] - 0.1))
        off_j = F.least(cap, F.greatest(F.lit(0.0), new["s"]), F.greatest(F.lit(0.0), cur["e"] - cur["s"] - 0.1))
        raw = F.when(j, -off_j).otherwise(off_l)
        off = F.when(hard | (F.round(F.abs(raw), 9) < min_offset), F.lit(0.0)).otherwise(raw)
        cur2 = F.struct(cur["cut_no"].alias("cut_no"), cur["role"].alias("role"), cur["s"].alias("s"), (cur["e"] + off).alias("e"), cur["d"].alias("d"))
        new2 = F.struct(new["cut_no"].alias("cut_no"), new["role"].alias("role"), (new["s"] + off).alias("s"), new["e"].alias("e"), new["d"].alias("d"))
        return F.when(F.size(acc) == 0, F.array(new)).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(cur2, new2)))

    f = fold_small(rows, key, ["cut_no"], ["role", "c_start", "c_end"], F.array().cast(t), step)
    return f.select(*key, F.explode("folded").alias("_x")).select(*key, F.col("_x.cut_no").alias("cut_no"), F.col("_x.s").alias("a_start"), F.col("_x.e").alias("a_end"))


# Words that announce a new topic.
TOPIC_MARKERS = ("теперь", "итак", "дальше", "кстати", "однако", "короче", "значит")


def jl_choice(prev_word: Column, next_word: Column, role_change: Column, emotion: Column) -> tuple[Column, Column]:
    """Kind of transition and its offset from the words and the emotion around a cut."""
    p, n = F.lower(F.trim(prev_word)), F.lower(F.trim(next_word))
    rules = [
        (role_change, "j_cut", 0.30),
        (p.endswith("?"), "l_cut", 0.25),
        (n.isin(*TOPIC_MARKERS), "j_cut", 0.35),
        (emotion >= 0.7, "l_cut", 0.30),
        (p.endswith("."), "hard", 0.08),
    ]
    kind = off = None
    for cond, k, o in rules:
        kind = F.when(cond, k) if kind is None else kind.when(cond, k)
        off = F.when(cond, o) if off is None else off.when(cond, o)
    return kind.otherwise("hard"), off.otherwise(F.lit(0.05))


def build_cues(flow: DataFrame, key, order: Sequence[str], *, mode: str, max_chars=20, max_lines=2, max_words=6, max_sec=3.0) -> DataFrame:
    """Words on plan time -> cues: (key, seg_no, cue_no, start, end, text).

    ``flow``: key, seg_no, order, word, local_start, local_end. A cue never crosses a segment, and a segment
    is a few seconds of speech, so each one is folded as an array. Modes: ``word``, ``sentence``, ``chars``, ``legacy``.
    """
    key = [*key, "seg_no"]
    cap = max(1, max_chars) * max(1, max_lines)
    t = "array<struct<s:double,e:double,n:int,c:int,text:string,shut:boolean>>"

    def step(acc, x):
        cur = F.try_element_at(acc, F.lit(-1))
        stop = x["word"].rlike(r"[.!?…]$")
        n2, span = cur["n"] + 1, F.round(x["local_end"] - cur["s"], 9)
        if mode == "word":
            fits, shut_new, shut_on = F.lit(False), F.lit(True), F.lit(True)
        elif mode == "sentence":
            fits, shut_new, shut_on = F.lit(True), stop, stop
        elif mode == "chars":
            fits, shut_new, shut_on = cur["c"] + 1 + F.length(x["word"]) <= cap, stop, stop
        else:
            fits = F.lit(True)
            shut_on = stop | (n2 >= max_words) | (span >= max_sec)
            shut_new = stop | (F.round(x["local_end"] - x["local_start"], 9) >= max_sec)
        fresh = F.array(
            F.struct(x["local_start"].alias("s"), x["local_end"].alias("e"), F.lit(1).alias("n"), F.length(x["word"]).alias("c"), x["word"].alias("text"), shut_new.alias("shut"))
        )
        more = F.struct(
            cur["s"].alias("s"), x["local_end"].alias("e"), n2.alias("n"), (cur["c"] + 1 + F.length(x["word"])).alias("c"),
            F.concat_ws(" ", cur["text"], x["word"]).alias("text"), shut_on.alias("shut"),
        )
        on = (F.size(acc) > 0) & ~cur["shut"] & fits
        return F.when(on, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, fresh))

    f = fold_small(flow, key, list(order), ["word", "local_start", "local_end"], F.array().cast(t), step)
    c = f.select(*key, F.posexplode("folded").alias("cue_no", "_x"))
    return c.select(*key, "cue_no", F.col("_x.s").alias("start"), F.col("_x.e").alias("end"), F.col("_x.text").alias("text"))


def wrap_lines(text: Column, max_lines: int, max_chars: int) -> Column:
    """Greedy line wrap; a long word takes its own line, lines beyond ``max_lines`` join the last one."""
    words = F.filter(F.split(text, " "), lambda w: w != "")

    def step(acc, w):
        cur = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(w) < max_chars) & (F.length(cur) < max_chars) & (F.length(cur) + 1 + F.length(w) <= max_chars)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", cur, w)))).otherwise(F.concat(acc, F.array(w)))

    lines = F.aggregate(words, F.array().cast("array<string>"), step)
    if max_lines <= 1:
        return text
    over = F.concat(
        F.slice(lines, 1, max_lines - 1), F.array(F.array_join(F.slice(lines, F.lit(max_lines), F.greatest(F.size(lines) - max_lines + 1, F.lit(0))), " "))
    )
    return F.array_join(F.when(F.size(lines) > max_lines, over).otherwise(lines), "\n")


def smooth_track(points: DataFrame, key, t: str, x: str, *, alpha: float, dead_zone: float) -> DataFrame:
    """Exponential smoothing, then points that moved less than ``dead_zone`` since the last kept one are dropped.

    The last sample is kept or prolongs the last kept point; an unmoving track is one point. ``key`` names one
    clip's track, whose length a clip bounds.
    """
    key = list(key)
    st = "struct<ema:double,pts:array<struct<t:double,x:double>>>"
    zero = F.from_json(F.lit("{\"pts\":[]}"), "ema double, pts array<struct<t:double,x:double>>").cast(st)

    def ema(acc, p):
        e = F.when(acc["ema"].isNull(), p[x]).otherwise(alpha * p[x] + (1 - alpha) * acc["ema"])
        return F.struct(e.alias("ema"), F.concat(acc["pts"], F.array(F.struct(p[t].alias("t"), e.alias("x")))).alias("pts"))

    f = fold_small(points, key, [t], [x], zero, ema, lambda a: a["pts"], "_pts")

    def keep(acc, p):
        moved = F.round(F.abs(p["x"] - F.try_element_at(acc, F.lit(-1))["x"]), 9) >= dead_zone
        return F.when((F.size(acc) == 0) | moved, F.concat(acc, F.array(p))).otherwise(acc)

    inner = F.slice("_pts", F.lit(1), F.greatest(F.size("_pts") - 1, F.lit(1)))
    f = f.withColumn("_k", F.aggregate(inner, F.array().cast("array<struct<t:double,x:double>>"), keep))
    last, prev = F.try_element_at("_pts", F.lit(-1)), F.try_element_at("_k", F.lit(-1))
    still = F.round(F.abs(last["x"] - prev["x"]), 9) < dead_zone
    longer = F.concat(F.slice("_k", F.lit(1), F.size("_k") - 1), F.array(F.struct(last["t"].alias("t"), prev["x"].alias("x"))))
    f = f.withColumn("_k", F.when(F.size("_k") > 1, F.when(still, longer).otherwise(F.concat("_k", F.array(last)))).otherwise(F.col("_k")))
    return f.select(*key, F.posexplode("_k").alias("kf_no", "_x")).select(*key, "kf_no", F.col("_x.t").alias(t), F.col("_x.x").alias(x))


# Damping ratio per profile and the natural frequency of the spring.
DAMPING = {"underdamped": 0.7, "critically_damped": 1.0, "overdamped": 1.3}
NATURAL_FREQ = 8.0


def spring_smooth(points: DataFrame, key, t: str, x: str, *, profile: str = "critically_damped", start: float = 0.5) -> DataFrame:
    """Damped oscillator that follows ``x``; one row per sample with the smoothed value in [0, 1]."""
    key = list(key)
    w, z = NATURAL_FREQ, DAMPING[profile]
    st = "t double, p double, v double, pts array<struct<t:double,x:double>>"
    zero = F.from_json(F.lit(f'{{"p":{start},"v":0.0,"pts":[]}}'), st)

    def step(a, s):
        dt = F.greatest(F.lit(1e-3), F.coalesce(s[t] - a["t"], F.lit(0.0)))
        target = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s[x]))
        v = a["v"] + (-(w**2) * (a["p"] - target) - 2 * z * w * a["v"]) * dt
        p = a["p"] + v * dt
        shown = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        return F.struct(s[t].alias("t"), p.alias("p"), v.alias("v"), F.concat(a["pts"], F.array(F.struct(s[t].alias("t"), shown.alias("x")))).alias("pts"))

    f = fold_small(points, key, [t], [x], zero, step, lambda a: a["pts"], "_pts")
    return f.select(*key, F.explode("_pts").alias("_x")).select(*key, F.col("_x.t").alias(t), F.col("_x.x").alias("smooth"))


def trim_to_budget(segs: DataFrame, key, *, limit: float = PLAN_MAX) -> DataFrame:
    """Segments of a plan that survive a length limit: critical roles stay, others are added by score while they fit.

    When critical roles alone exceed it: the first hook and the last peak or payoff. ``segs``: key, id, role, start,
    dur, score. A plan has few segments.
    """
    key = list(key)
    crit = F.col("role").isin("hook", "peak", "payoff")
    s = segs.withColumns({"_crit": crit})
    a = s.groupBy(*key).agg(
        F.sum("dur").alias("_total"), F.sum(F.when(crit, F.col("dur")).otherwise(0.0)).alias("_need"),
        F.min_by("id", F.when(F.col("role") == "hook", F.struct("seg_no"))).alias("_hook"),
        F.max_by("id", F.when(F.col("role").isin("peak", "payoff"), F.struct("seg_no"))).alias("_end"),
    )
    s = s.join(a, key)
    opt = s.filter((F.round("_total", 9) > limit) & (F.round("_need", 9) < limit) & ~F.col("_crit"))

    def step(acc, x):
        fits = F.round(acc["used"] + x["dur"], 9) <= F.round(F.lit(limit) - x["_need"], 9)
        return F.struct(
            F.when(fits, acc["used"] + x["dur"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"),
        )

    zero = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<bigint>").alias("ids"))
    kept = fold_small(opt.withColumn("_neg", -F.col("score")), key, ["_neg", "seg_no"], ["dur", "_need", "id"], zero, step, lambda r: r["ids"], "_ids")
    s = s.join(kept, key, "left")
    keep = (
        F.when(F.round("_total", 9) <= limit, F.lit(True))
        .when(F.round("_need", 9) < limit, F.col("_crit") | F.coalesce(F.array_contains("_ids", F.col("id")), F.lit(False)))
        .otherwise(F.coalesce(F.col("id") == F.col("_hook"), F.lit(False)) | F.coalesce(F.col("id") == F.col("_end"), F.lit(False)))
    )
    return s.filter(keep).drop("_crit", "_total", "_need", "_hook", "_end", "_ids")


def chapters(bounds: DataFrame, duration: DataFrame, ends: DataFrame, *, shortest: float = 60.0, longest: float = 300.0, near: float = 15.0, key=("source_id",)) -> DataFrame:
    """Boundaries (source_id, at, confidence) -> contiguous chapters (source_id, ch_no, start, end, confidence).

    A chapter below ``shortest`` joins its weaker neighbour, from left to right; one above ``longest`` is halved at the nearest segment
    end (``ends``: source_id, end) within ``near`` of the middle, again and again. What is merged cannot cross two chapters in a row
    that are long enough: the second one of them starts a run that is merged by itself, so no source is ever one array.
    """
    key = list(key)
    d = duration.select(*key, "duration")
    pts = bounds.select(*key, "at", "confidence", F.lit(0).alias("_z"))
    some = pts.select(*key).distinct().withColumn("_some", F.lit(True))
    last = d.join(some, key, "left").select(*key, F.col("duration").alias("at"), F.when(F.col("_some"), F.lit(0.6)).otherwise(F.lit(0.7)).alias("confidence"), F.lit(1).alias("_z"))
    # boundaries of sources without a duration are left out
    b = ordered_blocks(pts.join(d.select(*key), key, "left_semi").unionByName(last), key, ["_z", "at", "confidence"])
    order = ["_z", "at", "confidence"]
    c = carried(b, key, order, {"_ps": lag("at"), "_no": row_index()})
    c = c.withColumn("s", F.coalesce("_ps", F.lit(0.0))).withColumn("_long", F.round(F.col("at") - F.col("s"), 9) >= shortest)
    c = carried(c, key, order, {"_pl": lag("_long")})
    c = c.withColumn("_head", (F.col("_long") & F.coalesce("_pl", F.lit(True))).cast("long"))
    c = carried(c, key, order, {"_run": run_sum("_head")})
    g = c.groupBy(*key, "_run").agg(F.sort_array(F.collect_list(F.struct("_no", "s", F.col("at").alias("e"), F.col("confidence").alias("c")))).alias("_r"))
    g = g.withColumn("_c", F.transform("_r", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["c"].alias("c"))))
    empty = F.array().cast("array<struct<s:double,e:double,c:double>>")

    def merge(acc, i):
        """acc: done chapters and the index up to which input rows are used."""
        ch, right = F.element_at("_c", i + 1), F.get("_c", i + 1)
        left = F.try_element_at(acc["done"], F.lit(-1))
        is_short = F.round(ch["e"] - ch["s"], 9) < shortest
        has_l, has_r = F.size(acc["done"]) > 0, right.isNotNull()
        into_left = has_l & (~has_r | (left["c"] <= right["c"]))

        def glue(a, b):
            return F.struct(a["s"].alias("s"), b["e"].alias("e"), F.least(a["c"], b["c"]).alias("c"))

        push = F.concat(acc["done"], F.array(ch))
        to_left = F.concat(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1), F.array(glue(left, ch)))
        to_right = F.concat(acc["done"], F.array(glue(ch, right)))
        done = F.when(~is_short, push).when(into_left, to_left).when(has_r, to_right).otherwise(push)
        used = F.when(is_short & ~into_left & has_r, i + 2).otherwise(i + 1)
        skip = acc["used"] > i
        return F.struct(F.when(skip, acc["done"]).otherwise(done).alias("done"), F.when(skip, acc["used"]).otherwise(used).alias("used"))

    zero = F.struct(empty.alias("done"), F.lit(0).alias("used"))
    g = g.withColumn("_m", F.aggregate(F.sequence(F.lit(0), F.size("_c") - 1), zero, merge, lambda a: a["done"]))
    c = g.select(*key, F.explode("_m").alias("_x")).select(*key, F.col("_x.s").alias("start"), F.col("_x.e").alias("end"), F.col("_x.c").alias("confidence"))

    # halve long chapters: every round doubles the parts, so rounds grow with the log of the longest
    done = []
    while True:
        c = materialize(c)
        done.append(c.filter(F.round(F.col("end") - F.col("start"), 9) <= longest))
        long = c.filter(F.round(F.col("end") - F.col("start"), 9) > longest)
        if long.isEmpty():
            break
        long = long.withColumns({"_mid": (F.col("start") + F.col("end")) / 2, "_id": F.xxhash64(*key, "start")})
        n = nearest_within(long, ends.select(*key, F.col("end").alias("_e")), key, "_mid", "_e", near, id="_id", out="_at")
        at = F.when((F.col("_at") > F.col("start")) & (F.col("_at") < F.col("end")), F.col("_at")).otherwise(F.col("_mid"))
        n = n.withColumns({"_at": at, "_cf": F.col("confidence") * 0.9})
        halves = F.array(F.struct(F.col("start").alias("s"), F.col("_at").alias("e")), F.struct(F.col("_at").alias("s"), F.col("end").alias("e")))
        c = n.select(*key, F.explode(halves).alias("_h"), "_cf").select(*key, F.col("_h.s").alias("start"), F.col("_h.e").alias("end"), F.col("_cf").alias("confidence"))
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    return running(out, key, ["start"], {"ch_no": row_index()})


def fixed_chapters(duration: DataFrame, *, shortest: float = 60.0, longest: float = 300.0) -> DataFrame:
    """Equal chapters of about the mean allowed length, for sources without boundaries."""
    n = F.greatest(F.lit(1), F.bround(F.col("duration") / ((shortest + longest) / 2)).cast("int"))
    d = duration.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    length = F.col("duration") / F.col("_n")
    return d.select("source_id", (F.col("_i") + 1).alias("ch_no"), (F.col("_i") * length).alias("start"), F.when(F.col("_i") == F.col("_n") - 1, F.col("duration")).otherwise((F.col("_i") + 1) * length).alias("end"))

"""Poses: the vectors of a label play the frames of a stream, three numbers a key point, each query beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.operators import decoding, hands, poses, release
from spanwright.sources.tables import table

BODY = list(range(9))
PARTS = [(list(range(9, 15)), 9), (list(range(15, 21)), 20)]
WINDOW = 16

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform(
        F.sequence(F.lit(0), F.lit(20)),
        lambda k: F.struct(*[F.get("embedding", k * 3 + i).cast("double").alias(c) for i, c in enumerate("xy")], (F.abs(F.get("embedding", k * 3 + 2)) * 4).cast("double").alias("c")),
    )
    w = Window.partitionBy("stream_id").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.coalesce("label", F.lit(-1)).alias("stream_id"), "vec_id", points.alias("kp"))
    return rows.select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), "kp")


FRAMES_SQL = """with f as (select coalesce(label, -1) as stream_id, row_number() over (partition by coalesce(label, -1) order by vec_id) - 1 as frame,
  list_transform(range(0, 21), lambda k: {'x': embedding[k * 3 + 1]::double, 'y': embedding[k * 3 + 2]::double, 'c': (abs(embedding[k * 3 + 3]) * 4::float)::double}) as kp from embeddings)"""


@query(f"""{FRAMES_SQL}, p as (select stream_id, frame // {WINDOW} as win, unnest(kp[1:9]) as p from f)
select stream_id, win as window, round((min(p.x) + max(p.x) - greatest(max(p.x) - min(p.x), max(p.y) - min(p.y))) / 2, 6) as "left", round((min(p.y) + max(p.y) - greatest(max(p.x) - min(p.x), max(p.y) - min(p.y))) / 2, 6) as top,
  round(case when count(*) >= 4 then greatest(max(p.x) - min(p.x), max(p.y) - min(p.y)) else 0 end, 6) as scale from p where p.c > 0.3 group by 1, 2""")
def body_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = poses.body_boxes(_frames(spark, sf_dir).withColumn("kp", F.slice("kp", 1, 9)), WINDOW)
    return found.withColumns({c: F.round(c, 6) for c in ("left", "top", "scale")})


@query(f"""{FRAMES_SQL}, p as (select stream_id, frame // {WINDOW} as win, unnest(kp[1:9]) as p from f),
b as (select stream_id, win, min(p.x) as x0, max(p.x) as x1, min(p.y) as y0, max(p.y) as y1, greatest(max(p.x) - min(p.x), max(p.y) - min(p.y)) as s from p where p.c > 0.3 group by 1, 2 having count(*) >= 4 and greatest(max(p.x) - min(p.x), max(p.y) - min(p.y)) > 0),
k as (select stream_id, frame, i, kp[i + 1] as p, case when i < 15 then kp[10] else kp[21] end as a from f, unnest(range(0, 21)) t(i)),
v as (select k.*, s is not null and p.c > 0.3 as seen, case when i < 9 then ((p.x - (x0 + x1 - s) / 2) / s - 0.5) * 2 else (p.x - a.x) / s end as x, case when i < 9 then ((p.y - (y0 + y1 - s) / 2) / s - 0.5) * 2 else (p.y - a.y) / s end as y
  from k left join b on b.stream_id = k.stream_id and b.win = frame // {WINDOW}),
c as (select stream_id, frame, i, case when seen then greatest(least(x, 1), -1) else 0 end as x, case when seen then greatest(least(y, 1), -1) else 0 end as y, case when seen then least(p.c, 1) else 0 end as c from v)
select stream_id, frame, round(sum(x * (i + 1)), 6) as x, round(sum(y * (i + 1)), 6) as y, round(sum(c), 6) as c from c group by 1, 2""")
def normalised_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the normalised points, weighted by their place, of every frame."""
    made = poses.normalise(_frames(spark, sf_dir), WINDOW, BODY, PARTS)
    total = lambda c, weigh: F.round(F.aggregate(F.transform("kp", lambda p, i: p[c] * (i + 1 if weigh else 1)), F.lit(0.0), lambda s, v: s + v), 6)
    return made.select("stream_id", "frame", total("x", True).alias("x"), total("y", True).alias("y"), total("c", False).alias("c"))


MOTION_SQL = f"""{FRAMES_SQL}, b as (select *, lag(kp) over (partition by stream_id order by frame) as q from f),
m as (select stream_id, frame, median(case when kp[i].c > 0.3 and q[i].c > 0.3 then sqrt(pow(kp[i].x - q[i].x, 2) + pow(kp[i].y - q[i].y, 2)) end) as motion from b, unnest(range(1, 22)) t(i) group by 1, 2)"""


@query(f"""{MOTION_SQL} select stream_id, frame, round(motion, 6) as motion, round(case when count(motion) over w > 2.5 then avg(motion) over w end, 6) as mean
from m window w as (partition by stream_id order by frame rows between 2 preceding and 2 following)""")
def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = poses.moving_mean(poses.motion(_frames(spark, sf_dir)), "motion", 5)
    return found.select("stream_id", "frame", F.round("motion", 6).alias("motion"), F.round("mean", 6).alias("mean"))


@query(f"""{FRAMES_SQL}, e as (select stream_id, frame from f where len(list_filter(kp[1:9], lambda p: p.c > 0.3)) < 6),
n as (select *, case when frame - lag(frame) over (partition by stream_id order by frame) - 1 < 2 then 0 else 1 end as fresh from e),
r as (select *, sum(fresh) over (partition by stream_id order by frame rows unbounded preceding) as run from n)
select stream_id, min(frame) as a, max(frame) + 1 as b from r group by stream_id, run having max(frame) + 1 - min(frame) >= 2""")
def empty_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames that show fewer than six points of the body."""
    few = F.size(F.filter(F.slice("kp", 1, 9), lambda p: p["c"] > poses.SEEN)) < 6
    return poses.flag_runs(_frames(spark, sf_dir).select("stream_id", "frame", few.alias("flag")), 2, 2)


@query(f"""{FRAMES_SQL}, s as (select stream_id, count(*) as stored from f group by 1),
g as (select stream_id, k, least(floor(k * 30.0::double / 24 + 0.5), stored - 1)::bigint as frame from s, unnest(range(0, greatest(0, ceil((stored - 0.5::double) * 24 / 30)::bigint))) t(k))
select g.stream_id, g.k as frame, g.frame as shown, round(kp[1].x, 6) as x from g join f on f.stream_id = g.stream_id and f.frame = g.frame""")
def resampled_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams stored at 30 frames a second on the grid of 24."""
    frames = _frames(spark, sf_dir)
    streams = frames.groupBy("stream_id").agg(F.count("*").alias("stored")).withColumn("source_fps", F.lit(30.0))
    made = poses.resample(frames, streams, 24.0).join(streams, "stream_id")
    shown = poses.stored_frame(F.col("frame"), F.col("stored"), F.lit(24.0), F.col("source_fps"))
    return made.select("stream_id", "frame", shown.alias("shown"), F.round(F.get("kp", F.lit(0))["x"], 6).alias("x"))


def _drawn_sql(a: str, b: str, seed: int) -> str:
    step = "({} * 1103515245 + 12345) % 2147483648"
    return f"({step.format('(' + step.format(f'(({a} * 7919 + {b} * 104729 + {seed * 15_485_863}) % 2147483648)') + ')')}) / 2147483648.0::double"


@query(f"""{FRAMES_SQL}, s as (select stream_id, count(*) as stored from f group by 1), n as (select *, greatest(1, round_even(stored * 24.0::double / 30, 0)::bigint) as n from s)
select stream_id, k as place, round_even(k * (stored - 1)::double / greatest(1, n - 1), 0)::bigint as frame from n, unnest(range(0, n)) t(k)""")
def thinned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of 30 frames a second with as many frames as at 24."""
    frames = _frames(spark, sf_dir)
    streams = frames.groupBy("stream_id").agg(F.count("*").alias("stored")).withColumn("source_fps", F.lit(30.0))
    return poses.thinned(frames, streams, 24.0).select("stream_id", "place", "frame")


@query(f"""{FRAMES_SQL}, s as (select *, frame > 0 and frame < max(frame) over (partition by stream_id) as inner_ from f), r as (select *, row_number() over (partition by stream_id, inner_ order by {_drawn_sql("stream_id", "(frame + 1)", 7)}, frame) as place,
  floor((count(*) filter (where inner_) over (partition by stream_id)) * 0.4::double * {_drawn_sql("stream_id", "0", 7)}) as n_drop from s)
select stream_id, frame, len(list_filter(range(1, 22), lambda i: kp[i].c > 0.3 and not (i between 10 and 15 and {_drawn_sql("stream_id", "1", 7)} < 0.5) and not (i between 16 and 21 and {_drawn_sql("stream_id", "2", 7)} < 0.5))) as n_seen from r where not inner_ or place > n_drop""")
def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that lost up to 40 % of their inner frames and, half of them, a part; how many points each frame still shows."""
    made = poses.drop_parts(poses.drop_frames(_frames(spark, sf_dir), 0.4, 7), [at for at, _ in PARTS], 0.5, 7)
    return made.select("stream_id", "frame", F.size(F.filter("kp", lambda p: p["c"] > poses.SEEN)).cast("long").alias("n_seen"))


@query(None)
def decoded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 16 frames of four scores, decoded under a prior on durations; tests compare with all paths."""
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1), lambda k: F.transform(F.slice("embedding", k * 4 + 1, 4), lambda x: x * 8))
    streams = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stream_id"), rows.cast("array<array<double>>").alias("scores"))
    return streams.select("stream_id", decoding.decode(-0.5, 0.6, 1.5, 8.0)("scores").alias("tags"))


CLIP, FPS = 16, 25.0
RELEASE_PARTS = [(list(range(9, 15)), 9), (list(range(15, 21)), 15)]
SHAPED_SQL = f"""{FRAMES_SQL}, s as (select *, frame // {CLIP} as clip, kp[1] as a, kp[2] as b, kp[1].c > 0.3 and kp[2].c > 0.3 as shown from f),
c as (select stream_id, clip, avg((a.x + b.x) / 2) as cx, avg((a.y + b.y) / 2) as cy, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as wide from s where shown group by 1, 2),
k as (select stream_id, clip, frame, i, kp[i + 1] as p, case when i between 9 and 14 then kp[10] when i > 14 then kp[16] end as r from s, unnest(range(0, 21)) t(i)),
sh as (select k.stream_id, frame, i, case when i in (6, 7) then 0 when r is not null then (p.x - r.x) / wide else (p.x - cx) / wide end as x, case when i in (6, 7) then 0 when r is not null then (p.y - r.y) / wide else (p.y - cy) / wide end as y,
  wide is not null and (i in (6, 7) or (p.c > 0.3 and coalesce(r.c, 1) > 0.3)) as ok from k left join c using (stream_id, clip)),
st as (select i, avg(x) as mx, avg(y) as my, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) as sx, sqrt(greatest(avg(y * y) - avg(y) * avg(y), 0)) as sy from sh where ok group by 1)"""


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.by_shoulders(_frames(spark, sf_dir), CLIP, RELEASE_PARTS, [6, 7])


@query(f"{SHAPED_SQL} select i::int as point, round(mx, 6) as mx, round(my, 6) as my, round(sx, 6) as sx, round(sy, 6) as sy from st")
def point_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = release.point_table(_shaped(spark, sf_dir))
    return found.select("point", *[F.round(c, 6).alias(c) for c in ("mx", "my", "sx", "sy")])


@query(f"""{SHAPED_SQL}, n as (select stream_id, frame, i, case when ok then (x - mx) / case when sx > 1e-6 then sx else 1 end else 0 end as x, case when ok then (y - my) / case when sy > 1e-6 then sy else 1 end else 0 end as y from sh left join st using (i)),
v as (select *, coalesce(x - lag(x) over w, 0) * {FPS} as vx, coalesce(y - lag(y) over w, 0) * {FPS} as vy from n window w as (partition by stream_id, i order by frame))
select stream_id, frame, round(sum(x * (i + 1)), 4) as x, round(sum(y * (i + 1)), 4) as y, round(sum(vx * (i + 1)), 3) as vx, round(sum(vy * (i + 1)), 3) as vy from v group by 1, 2""")
def release_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised points and their velocities of every frame, in sums weighted by place."""
    shaped = _shaped(spark, sf_dir)
    made = release.with_velocity(release.standardised(shaped, release.point_table(shaped)), FPS)
    total = lambda a, c: F.aggregate(F.transform(a, lambda p, i: p[c] * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return made.select(
        "stream_id", "frame", F.round(total("xy", "x"), 4).alias("x"), F.round(total("xy", "y"), 4).alias("y"), F.round(total("v", "x"), 3).alias("vx"), F.round(total("v", "y"), 3).alias("vy")
    )


RATES, STORED_FPS, LINE, SHARE = [24.0, 25.0], 30.0, 3.0, 0.25
LINES_SQL = ", ".join(f"sqrt(pow(sum(x * cos({q} * frame)), 2) + pow(sum(x * sin({q} * frame)), 2)) / sum(x) as {name}" for name, q in [("l24", 2 * 3.141592653589793 * 0.2), ("l25", 2 * 3.141592653589793 / 6), *[(f"q{k}", 2 * 3.141592653589793 * q) for k, q in enumerate(release.QUIET)]])


@query(f"""{FRAMES_SQL}, n as (select stream_id, count(*) as n from f group by 1),
g as (select stream_id, s as frame, case when stream_id % 2 = 0 then s * 4 // 5 else s end as shown from n, unnest(range(0, case when stream_id % 2 = 0 then n * 5 // 4 else n end)) t(s)),
d as (select g.stream_id, g.frame, kp from g join f on f.stream_id = g.stream_id and f.frame = g.shown), b as (select *, lag(kp) over (partition by stream_id order by frame) as q from d),
m as (select stream_id, frame, median(case when kp[i].c > 0.3 and q[i].c > 0.3 then sqrt(pow(kp[i].x - q[i].x, 2) + pow(kp[i].y - q[i].y, 2)) end) as motion from b, unnest(range(1, 22)) t(i) group by 1, 2),
x as (select stream_id, frame, coalesce(motion, median(motion) over (partition by stream_id)) as x from m), l as (select stream_id, {LINES_SQL} from x group by 1),
p as (select stream_id, case when l24 >= l25 then 5 else 6 end as n from l where greatest(l24, l25) > {LINE} * list_sort([{", ".join(f"q{k}" for k in range(7))}])[4]),
w as (select m.*, row_number() over (partition by m.stream_id, frame // n order by motion nulls last, frame) <= round_even(count(*) over (partition by m.stream_id, frame // n) / n::double, 0) as goes from m join p using (stream_id)),
e as (select stream_id, {SHARE} * median(motion) filter (where not goes) as most, median(motion) filter (where goes) as gone from w group by 1)
select stream_id, frame from w join e using (stream_id) where gone <= most and (not goes or motion is null or motion > most)""")
def content_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even streams of 24 frames a second, filled to 30 by repeats, without their repeats again; odd ones have none."""
    frames = _frames(spark, sf_dir)
    even = F.col("stream_id") % 2 == 0
    sizes = frames.groupBy("stream_id").agg(F.count("*").alias("n"))
    last = F.when(even, F.floor(F.col("n") * 5 / 4)).otherwise(F.col("n")) - 1
    filled = sizes.select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"))
    shown = filled.withColumn("frame", F.when(even, F.floor(F.col("at") * 4 / 5)).otherwise(F.col("at")))
    stored = shown.join(frames, ["stream_id", "frame"]).select("stream_id", F.col("at").alias("frame"), "kp")
    return release.content_frames(poses.motion(stored), STORED_FPS, RATES, LINE, SHARE)


@query(f"""{FRAMES_SQL}, s as (select stream_id, count(*) as stored from f group by 1),
g as (select stream_id, k, least(floor(k * 30.0::double / 24 + 0.5), stored - 1)::bigint as shown from s, unnest(range(0, greatest(0, ceil((stored - 0.5::double) * 24 / 30)::bigint))) t(k)),
e as (select stream_id, frame from f where len(list_filter(kp[1:9], lambda p: p.c > 0.3)) < 6), n as (select *, case when frame - lag(frame) over (partition by stream_id order by frame) - 1 < 2 then 0 else 1 end as fresh from e),
r as (select *, sum(fresh) over (partition by stream_id order by frame rows unbounded preceding) as run from n), runs as (select stream_id, min(frame) as a, max(frame) + 1 as b from r group by stream_id, run having max(frame) + 1 - min(frame) >= 2),
i as (select distinct g.stream_id, k from g join runs on runs.stream_id = g.stream_id and shown >= a and shown < b), j as (select *, k - row_number() over (partition by stream_id order by k) as isle from i)
select stream_id, min(k) as a, max(k) + 1 as b from j group by stream_id, isle""")
def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of ``empty_runs``, stored at 30 frames a second, on the grid of 24."""
    stored = _frames(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("stored")).withColumn("grid", poses.grid_length(F.col("stored"), F.lit(24), F.lit(30)))
    return release.grid_runs(empty_runs(spark, sf_dir), stored, 30, 24)


@query(f"""{FRAMES_SQL}, h as (select stream_id, frame, i, kp[4] as a, kp[5] as b, kp[i + 1] as h, kp[4].c > 0.3 as sa, kp[5].c > 0.3 as sb from f, unnest(range(9, 15)) t(i)),
o as (select stream_id, frame, i - 9 as at_, case when sa then sqrt(pow(a.x - h.x, 2) + pow(a.y - h.y, 2)) end as wa, case when sb then sqrt(pow(b.x - h.x, 2) + pow(b.y - h.y, 2)) end as wb from h),
l as (select stream_id, frame, at_, wa as way from o where wa < 0.2 union all select stream_id, frame, null, 0 from f), r as (select stream_id, frame, at_, wb as way from o where wb < 0.2 union all select stream_id, frame, null, 0 from f),
p as (select l.stream_id, l.frame, l.at_ as lh, r.at_ as rh, row_number() over (partition by l.stream_id, l.frame order by (l.at_ is not null)::int + (r.at_ is not null)::int desc, l.way + r.way, l.at_ nulls first, r.at_ nulls first) as n
  from l join r using (stream_id, frame) where l.at_ is distinct from r.at_ or l.at_ is null)
select stream_id, frame, lh::int as "left", rh::int as "right" from p where n = 1""")
def claimed_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points 3 and 4 play wrists, 9 to 14 the hands found in the picture."""
    wrist = lambda k: F.when(F.get("kp", F.lit(k))["c"] > poses.SEEN, F.get("kp", F.lit(k)))
    made = _frames(spark, sf_dir).withColumn("hand", hands.claimed(wrist(3), wrist(4), F.slice("kp", 10, 6), 0.2))
    return made.select("stream_id", "frame", "hand.left", "hand.right")


@query(f"""{FRAMES_SQL}, s as (select stream_id, median(case when kp[1].c > 0.3 and kp[2].c > 0.3 then sqrt(pow(kp[1].x - kp[2].x, 2) + pow(kp[1].y - kp[2].y, 2)) end) as size from f group by 1),
b as (select *, lag(kp) over (partition by stream_id order by frame) as q from f),
v as (select stream_id, frame, size, list_max([case when kp[i].c > 0.1 and q[i].c > 0.1 and (kp[i].c > 0.5) = (q[i].c > 0.5) then sqrt(pow(kp[i].x - q[i].x, 2) + pow(kp[i].y - q[i].y, 2)) end for i in [10, 16]]) as way from b join s using (stream_id)),
a as (select stream_id, frame, case when size > 0 and way is not null then least(way * {FPS} / size, 20) end as act from v),
m as (select stream_id, frame, case when count(act) over w > 1.5 then avg(act) over w end as act from a window w as (partition by stream_id order by frame rows between 1 preceding and 1 following))
select stream_id, frame, round(case when count(act) over w > 2.5 then avg(act) over w end, 6) as activity from m window w as (partition by stream_id order by frame rows between 2 preceding and 2 following)""")
def hand_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points 9 and 15 play the hands; a sure point is of another kind than an unsure one."""
    p = lambda k: F.get("kp", F.lit(k))
    hand = lambda k: F.when(p(k)["c"] > 0.1, F.struct(p(k)["x"].alias("x"), p(k)["y"].alias("y"), (p(k)["c"] > 0.5).alias("kind")))
    width = F.when((p(0)["c"] > poses.SEEN) & (p(1)["c"] > poses.SEEN), F.sqrt(F.pow(p(0)["x"] - p(1)["x"], 2) + F.pow(p(0)["y"] - p(1)["y"], 2)))
    seen = _frames(spark, sf_dir).select("stream_id", "frame", F.array(hand(9), hand(15)).alias("hands"), width.alias("width"))
    return hands.activity(seen, FPS, 20.0, [3, 5]).withColumn("activity", F.round("activity", 6))

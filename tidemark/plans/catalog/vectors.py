"""Samples, splits, vector aggregates and embeddings."""
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as bs, concept as cd, contexts as cx, embedding as em, ranking as rk, sampling as sp, vectors as vc
from tidemark.operators.concept import equal_slices
from tidemark.operators.windowing import positions
from tidemark.plans import datasets as ds
from tidemark.plans.catalog import query
from tidemark.plans.catalog import sql as twin
from tidemark.plans.catalog.ingestion import scratch
from tidemark.session import TEXTS, cut_lineage

KEYED = twin.order_key(42, "window_id", "post_id", tie="post_id")
ITEMS = "select window_id, post_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from vectors"


def _vectors(spark, sf_dir):
    return ds.vectors(spark, sf_dir).select("window_id", "post_id", "embedding")


@query(sql=f"""
select window_id, post_id, rn from (select window_id, post_id, row_number() over (partition by window_id order by {KEYED}) as rn from vectors) where rn <= 100""")
def sample_per_window(spark, sf_dir):
    return sp.sample_per_window(_vectors(spark, sf_dir), 100, 42).select("window_id", "post_id", F.col("rn").cast("long").alias("rn"))


@query(sql=f"""
select window_id, post_id, place <= round_even(n * 0.8::double, 0) as is_heldout
from (select window_id, post_id, row_number() over (partition by window_id order by {KEYED}) as place, count(*) over (partition by window_id) as n from vectors)""")
def holdout_split(spark, sf_dir):
    return sp.holdout_split(_vectors(spark, sf_dir), 0.8, 42).select("window_id", "post_id", "is_heldout")


@query(sql=f"""
select post_id, place <= round_even(n * 0.5::double, 0) as is_threshold
from (select post_id, row_number() over (order by {twin.order_key(42, "post_id", tie="post_id")}) as place, count(*) over () as n from vectors)""")
def split_reference(spark, sf_dir):
    return sp.split_reference(_vectors(spark, sf_dir), 0.5, 42).select("post_id", "is_threshold")


@query(sql=f"select window_id, post_id, row_number() over (partition by window_id order by {KEYED}) - 1 as rank from vectors")
def rank_by_hash(spark, sf_dir):
    keyed = _vectors(spark, sf_dir).withColumn("order_key", rk.order_key(42, "window_id", "post_id", tie="post_id"))
    return rk.rank_by_hash(keyed, ["window_id"]).select("window_id", "post_id", "rank")


@query(sql="select post_id, ntile(5) over (order by post_id) - 1 as sub_window from vectors")
def sub_windows(spark, sf_dir):
    """Equal contiguous slices of one ungrouped set."""
    rows = _vectors(spark, sf_dir).select("post_id")
    return equal_slices(rows, rows.count(), 5, ("post_id",)).select("post_id", F.col("sub_window").cast("long").alias("sub_window"))


def _components(df, column):
    return df.select("window_id", F.posexplode(column).alias("i", "x")).select("window_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(sql=f"select window_id, i, round(avg(x), 6) as x from ({ITEMS}) group by window_id, i")
def mean_pool(spark, sf_dir):
    return _components(vc.mean_pool(_vectors(spark, sf_dir)), "mean")


_SCALER = f"select i, avg(x) as m, stddev_pop(x) + 1e-6 as s from ({ITEMS}) group by i"


@query(sql=f"select i, round(m, 6) as mean, round(s, 6) as std from ({_SCALER})")
def fit_scaler(spark, sf_dir):
    row = vc.fit_scaler(_vectors(spark, sf_dir))
    return row.select(F.posexplode(F.arrays_zip("mean", "std")).alias("i", "v")).select(
        F.col("i").cast("long").alias("i"), F.round("v.mean", 6).alias("mean"), F.round("v.std", 6).alias("std"))


@query(sql=f"""
select post_id, round(sum((x - m) / s), 4) as total, round(max((x - m) / s), 5) as largest
from ({ITEMS}) join ({_SCALER}) using (i) group by post_id""")
def standardise(spark, sf_dir):
    rows = vc.standardise(_vectors(spark, sf_dir), vc.fit_scaler(_vectors(spark, sf_dir)))
    return rows.select("post_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
                       F.round(F.array_max("embedding"), 5).alias("largest"))


@query(sql="""
select post_id, round(list_max(scaled) / sqrt(list_sum(list_transform(scaled, lambda v: v * v))), 6) as largest, round(1.0::double, 6) as length
from (select post_id, list_transform(embedding::double[], lambda v: v * 3::double) as scaled from vectors)""")
def l2_normalise(spark, sf_dir):
    from tidemark.functions import vectors as vx

    scaled = _vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda v: v.cast("double") * 3))
    unit = vc.l2_normalise(scaled)
    return unit.select("post_id", F.round(F.array_max("embedding"), 6).alias("largest"), F.round(vx.norm(F.col("embedding")), 6).alias("length"))


@query(sql="""
with parts as (select window_id, i, count(*) as n, avg(x) as m, var_samp(x) as v from (
    select window_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from vectors) group by window_id, i),
  sums as (select window_id, var_samp(list_sum(embedding::double[])) as total from vectors group by window_id)
select window_id, max(n) as n, round(sum(m * m), 6) as mean_square, round(sum(v), 6) as trace, round(max(total), 6) as total
from parts join sums using (window_id) group by window_id""")
def gaussian_stats(spark, sf_dir):
    """Mean and covariance per window: squared mean, trace and sum of all entries."""
    stats = vc.gaussian_stats(_vectors(spark, sf_dir), "window_id")
    zero = F.lit(0.0)
    d = F.size("mean")
    diagonal = F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.get("covariance", i * (d + 1)))
    return stats.select(
        "window_id", "n", F.round(F.aggregate("mean", zero, lambda a, x: a + x * x), 6).alias("mean_square"),
        F.round(F.aggregate(diagonal, zero, lambda a, x: a + x), 6).alias("trace"),
        F.round(F.aggregate("covariance", zero, lambda a, x: a + x), 6).alias("total"))


@query(sql="select event_type, round(quantile_cont(value, 0.99), 6) as threshold from events group by event_type")
def p_threshold(spark, sf_dir):
    return bs.p_threshold(ds.table(spark, sf_dir, "events"), ["event_type"], 99.0, "value").withColumn("threshold", F.round("threshold", 6))


def fixed_weights(layer: int, members: int, rows: int, cols: str) -> str:
    """(m, r, w, b): one layer of the fixed encoder."""
    def w(c: str) -> str:
        k = f"(1009 * r + 917 * {c} + 613 * {layer} + 307 * m + 1)"
        return f"((({k} * {k} + 3 * {k}) % 2003 - 1001) / 1001.0::double / sqrt({cols}))"
    return f"(select m, r, list_transform(range({cols}), lambda c: {w('c')}) w, {w(cols)} b from range({members}) t(m), range({rows}) u(r))"


def fixed_set_layers(keys: str, hidden: int, output: int, members: int) -> str:
    """`concepts` (keys, m, v) from `pooled` (keys, m, p): the layers above the mean of a set."""
    def layer(number: int, rows: int) -> str:
        return fixed_weights(number, members, rows, str(hidden))
    return f"""mixed as (select {keys}, m, list(list_inner_product(p, w) + b order by r) v from pooled join {layer(1, hidden)} using (m) group by all),
hidden as (select {keys}, m, list(greatest(0, list_inner_product(v, w) + b) order by r) v from mixed join {layer(2, hidden)} using (m) group by all),
concepts as (select {keys}, m, list((list_inner_product(v, w) + b) / sqrt({members}) order by r) v
             from hidden join {layer(3, output)} using (m) group by all)"""


def _fixed_encoder(hidden: int, output: int, members: int, sizes: str) -> str:
    """Concept vectors in SQL: (window_id, size, m, v) of the fixed encoder for `sizes` (window_id, size)."""
    return f"""
scaler as (select list(m order by i) mu, list(s order by i) sd from ({_SCALER})),
rows as (select window_id, row_number() over (partition by window_id order by {KEYED}) as rn,
         list_transform(range(len(embedding)), lambda i: (embedding[i + 1]::double - mu[i + 1]) / sd[i + 1]) z from vectors, scaler),
sets as (select * from rows where rn <= 1000),
sizes as ({sizes}),
item_w as (select m, r, w, b from (select (select len(mu) from scaler) d), lateral {fixed_weights(0, members, hidden, "d")}),
features as (select window_id, rn, m, r, greatest(0, list_inner_product(z, w) + b) f from sets, item_w),
pooled as (select window_id, size, m, list(f order by r) p from (
    select window_id, size, m, r, avg(f) f from features join sizes using (window_id) where rn <= size group by all) group by all),
{fixed_set_layers("window_id, size", hidden, output, members)}"""


_OWN_SIZE = "select window_id, least(count(*), 1000) as size from vectors group by window_id"


@query(sql=f"""
with {_fixed_encoder(128, 64, 5, _OWN_SIZE)}
select window_id, size::bigint as size, (m * 64 + i)::int as place, round(x, 6) as value
from (select window_id, size, m, unnest(v) x, unnest(range(len(v))) i from concepts)""")
def encode_sets_fixed(spark, sf_dir):
    """Every component of every window's concept vector, by the fixed encoder at the published sizes."""
    params = cd.ConceptParams()
    rows = _vectors(spark, sf_dir)
    sets = sp.sample_per_window(rows, params.scoring_sample_size, params.seed)
    sizes = sets.groupBy("window_id").agg(F.array(F.count("*")).alias("sizes"))
    return cd.encode_sets(sets, sizes, cd.fixed_model(rows, params)).select("window_id", "size", F.posexplode("concept").alias("place", "x")).select(
        "window_id", "size", "place", F.round("x", 6).alias("value"))


@query(sql=f"""
with spots as (select window_id, row_number() over (order by window_id) - 1 as position, least(count(*), 1000) as n from vectors group by window_id),
target as (select window_id, position, count(*) over w as n_context, least(n, min(n) over w) as size from spots window w as (order by position rows between 10 preceding and 1 preceding)),
couples as (select t.window_id, t.position, t.size, c.window_id as context_id, c.position as context_position
          from target t join spots c on c.position between t.position - 10 and t.position - 1),
{_fixed_encoder(16, 8, 2, "select window_id, size from couples union select context_id, size from couples")},
whole as (select window_id, size, flatten(list(v order by m)) v from concepts group by all),
gaps as (select p.*, list_distance(a.v, b.v) gap from couples p join whole a on a.window_id = p.window_id and a.size = p.size
         join whole b on b.window_id = p.context_id and b.size = p.size)
select t.window_id, t.size::bigint as size, t.n_context::int as n_context, round(g.score, 6) as score, g.lag::int as lag from target t
left join (select window_id, max(gap) score, any_value(position) - arg_max(context_position, {{'gap': gap, 'earliest': -context_position}}) lag from gaps group by 1) g using (window_id)""")
def mcd_raw_fixed(spark, sf_dir):
    """Largest discrepancy of every window to the ten before it, by a small fixed encoder."""
    params = cd.ConceptParams(hidden_dim=16, output_dim=8, n_encoders=2)
    rows = _vectors(spark, sf_dir)
    sets = cut_lineage(sp.sample_per_window(rows, params.scoring_sample_size, params.seed).select("window_id", "rn", "embedding"))
    return cd.context_discrepancy(sets, cd.fixed_model(rows, params)).select(
        "window_id", "size", "n_context", F.round("mcddd_score", 6).alias("score"), F.col("mcddd_lag").alias("lag"))


_PLACES = "select window_id, cast(row_number() over (order by window_id) - 1 as integer) as position, count(*) as set_size from vectors group by window_id"


def _sets(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    sizes = rows.groupBy("window_id").agg(F.count("*").alias("set_size"))
    return positions(rows, 0).select("window_id", F.col("position").cast("int").alias("position")).join(sizes, "window_id")


@query(sql=f"""
with places as ({_PLACES})
select a.window_id, a.position, b.window_id as context_id, b.position as context_position from places a
join places b on b.position between a.position - 10 and a.position - 1""")
def context_pairs(spark, sf_dir):
    return cx.context_pairs(_sets(spark, sf_dir), 10)


@query(sql=f"""
select window_id, position, set_size, cast(count(*) over w as integer) as n_context, least(set_size, min(set_size) over w) as size from ({_PLACES})
window w as (order by position rows between 10 preceding and 1 preceding)""")
def context_frame(spark, sf_dir):
    return cx.context_frame(_sets(spark, sf_dir), 10)


@query(sql=f"""
with means as (select window_id, list(m order by i) as c from (select window_id, i, avg(x) as m from ({ITEMS}) group by window_id, i) group by window_id),
  places as ({_PLACES}), gaps as (select a.window_id, a.position, b.position as context_position, round(list_distance(ma.c, mb.c), 9) as gap from places a
    join places b on b.position between a.position - 10 and a.position - 1 join means ma on ma.window_id = a.window_id join means mb on mb.window_id = b.window_id)
select window_id, round(max(gap), 6) as score, cast(max(position) - arg_max(context_position, struct_pack(g := gap, p := -context_position)) as integer) as lag
from gaps group by window_id""")
def max_discrepancy(spark, sf_dir):
    """Largest distance to the ten previous windows with the mean vector as the concept."""
    from tidemark.operators.concept import max_discrepancy as largest

    size = F.lit(1).cast("long")
    concepts = vc.mean_pool(_vectors(spark, sf_dir)).select("window_id", size.alias("size"), F.col("mean").alias("concept"))
    pairs = cx.context_pairs(_sets(spark, sf_dir), 10).withColumn("size", size)
    return largest(concepts, pairs).select("window_id", F.round("mcddd_score", 6).alias("score"), F.col("mcddd_lag").alias("lag"))


@query(sql="select count(*) as n_posts, 256 as dim, count(*) as n_unit from posts")
def embed(spark, sf_dir):
    """Every cleaned post gets a vector of unit length (or zero when it has no token)."""
    from tidemark.functions import vectors as vx

    rows = em.embed(ds.posts(spark, sf_dir).select("post_id", "text"), 256)
    length = vx.norm(F.col("embedding"))
    good = (F.abs(length - 1) < 1e-4) | (length == 0)
    return rows.agg(F.count("*").alias("n_posts"), F.max(F.size("embedding")).alias("dim"), F.count_if(good).alias("n_unit"))


@query(sql="""
select count(*) as n_posts, (select count(distinct text) from posts) as n_cached, count(*) as n_matched from posts""")
def embed_cached(spark, sf_dir):
    """A second pass over the same texts embeds nothing new and returns the same vectors."""
    path = scratch(spark, "embeddings")
    posts = cut_lineage(ds.posts(spark, sf_dir).select("post_id", "event_time", "text"), compression=TEXTS)      # read four times

    def embedder(df):
        return em.embed(df, 64)

    em.embed_cached(posts, path, "hashing-64", embedder)
    again = em.embed_cached(posts, path, "hashing-64", embedder)
    direct = em.embed(posts, 64).select("post_id", "event_time", F.col("embedding").alias("expected"))
    counts = again.join(direct, ["post_id", "event_time"]).agg(
        F.count("*").alias("n_posts"), F.count_if(F.col("embedding") == F.col("expected")).alias("n_matched"))
    stored = spark.read.parquet(path).agg(F.count("*").alias("n_cached"))
    key = F.lit(0)
    return counts.withColumn("k", key).join(F.broadcast(stored.withColumn("k", key)), "k").drop("k")


@query(sql="select sha1(text) as text_sha1 from (select distinct text from posts) where text not in (select text from cleaned where source = 'view')")
def cache_misses(spark, sf_dir):
    """Distinct texts not cached yet, when the cache holds the texts of one source."""
    from tidemark.operators.windowing import clean_records

    cached = clean_records(ds.messages(spark, sf_dir)).filter("source = 'view'").select(
        F.lit("m").alias("model"), F.sha1("text").alias("text_sha1"))
    return em.cache_misses(ds.posts(spark, sf_dir), cached, "m").select("text_sha1")

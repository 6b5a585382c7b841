"""Both detectors on the daily vectors (14 reference windows, 16 stream windows) with the published parameters.

Detector B is trained in full, as is the published default; `score_windows_untrained` scores the published untrained variant.
"""
from pyspark.sql import functions as F

from tidemark.operators import concept as cd, frechet as fd, vectors as vc
from tidemark.operators.ranking import order_key
from tidemark.operators.sampling import split_reference
from tidemark.operators.windowing import positions, reference_windows, unseen
from tidemark.plans import datasets as ds, scoring
from tidemark.plans.catalog import query
from tidemark.plans.catalog import sql as twin
from tidemark.plans.catalog.ingestion import scratch
from tidemark.plans.catalog.vectors import KEYED, fixed_set_layers, fixed_weights
from tidemark.session import cut_lineage
from tidemark.sinks import models

FRECHET = fd.FrechetParams()
CONCEPT = cd.ConceptParams()
FIRST = "(select window_id from (select distinct window_id from vectors) order by window_id limit 14)"


def _vectors(spark, sf_dir):
    return cut_lineage(ds.vectors(spark, sf_dir).select("window_id", "window_start", "post_id", "embedding"))


def _split(vectors):
    reference = positions(vectors, ds.N_REFERENCE).filter("is_reference").select("window_id")
    return reference, reference_windows(vectors, reference), unseen(vectors, reference)


@query()
def fit_pca(spark, sf_dir):
    """Variance per component of the baseline half of the reference and the share kept."""
    _, reference, _ = _split(_vectors(spark, sf_dir))
    baseline = split_reference(reference, FRECHET.threshold_fraction, FRECHET.seed).filter("NOT is_threshold")
    moments = vc.pooled_moments(baseline)
    _, variances, share = fd.fit_pca(moments, FRECHET.pca_components)
    rows = [(i, round(float(v), 9), round(share, 9), moments.n) for i, v in enumerate(variances)]
    return spark.createDataFrame(rows, "component int, variance double, explained double, n long")


@query(sql=f"""
select cast(count(*) as bigint) as n_pool, cast(count(distinct window_id) as bigint) as n_groups from (select window_id, row_number() over (
    order by {twin.order_key(42, "post_id", tie="post_id")}) as place, count(*) over () as n from vectors where window_id in {FIRST}) where place <= round_even(n * 0.5::double, 0)""")
def threshold_pool(spark, sf_dir):
    _, reference, _ = _split(_vectors(spark, sf_dir))
    pool = fd.fit_frechet(reference, FRECHET).pool
    return pool.frame.agg(F.count("*").alias("n_pool"), F.countDistinct("grp").alias("n_groups"))


@query()
def project(spark, sf_dir):
    """PCA projection: squared length kept by the first components, per vector."""
    vectors = _vectors(spark, sf_dir)
    moments = vc.pooled_moments(vectors)
    basis, _, _ = fd.fit_pca(moments, FRECHET.pca_components)
    rows = vc.project(vectors.select("post_id", "embedding"), moments.mean, basis)
    return rows.select("post_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("kept"))


# With all components kept, the distance to a Gaussian with the baseline's own moments has a closed form in the
# traces; the mean part of the distance does not depend on the basis and is plain SQL.
@query(sql=f"""
with sampled as (select window_id, embedding from (select *, row_number() over (partition by window_id order by {KEYED}) as rn from vectors) where rn <= 1000),
  base as (select i, avg(x) as m from (select unnest(embedding)::double as x, unnest(range(len(embedding))) as i from (select *, row_number() over (
      order by {twin.order_key(42, "post_id", tie="post_id")}) as place, count(*) over () as n from vectors where window_id in {FIRST})
    where place > round_even(n * 0.5::double, 0)) group by i),
  own as (select window_id, i, avg(x) as m, count(*) as n from (select window_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from sampled) group by window_id, i)
select window_id, max(n) as n_used, round(sum((own.m - base.m) * (own.m - base.m)), 7) as mean_gap from own join base using (i) group by window_id""")
def window_mean_gap(spark, sf_dir):
    """Squared distance of every window's sample mean to the baseline mean, in the full PCA space."""
    from tidemark.operators.sampling import sample_per_window

    vectors = _vectors(spark, sf_dir)
    _, reference, _ = _split(vectors)
    baseline = split_reference(reference, FRECHET.threshold_fraction, FRECHET.seed).filter("NOT is_threshold")
    moments = vc.pooled_moments(baseline)
    basis, _, _ = fd.fit_pca(moments, len(moments.mean))
    sample = sample_per_window(vectors.select("window_id", "post_id", "embedding"), 1000, FRECHET.seed)
    stats = vc.gaussian_stats(vc.project(sample.select("window_id", "embedding"), moments.mean, basis), "window_id")
    gap = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)
    return stats.select("window_id", F.col("n").alias("n_used"), F.round(gap, 7).alias("mean_gap"))


@query()
def calibration_scores(spark, sf_dir):
    """Every calibration draw for every sample size that occurs."""
    vectors = _vectors(spark, sf_dir)
    _, reference, _ = _split(vectors)
    model = fd.fit_frechet(reference, FRECHET)
    sizes = vectors.groupBy("window_id").agg(F.count("*").alias("n")).select(
        F.least("n", F.lit(FRECHET.window_sample_size), F.lit(model.pool.size)).alias("size"))
    return fd.calibration_scores(model, sizes).withColumn("statistic", F.round("statistic", 6))


@query("calibration_draws", sql="""
select size, draw from (select distinct least(count(*), 1000) as size from vectors group by window_id) cross join (select unnest(range(1000)) as draw)""")
def calibration_draws(spark, sf_dir):
    sizes = ds.vectors(spark, sf_dir).groupBy("window_id").agg(F.least(F.count("*"), F.lit(1000)).alias("size"))
    return fd.calibration_draws(sizes, FRECHET.n_calibration)


@query()
def calibrate(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    _, reference, _ = _split(vectors)
    sizes = vectors.groupBy("window_id").agg(F.least(F.count("*"), F.lit(FRECHET.window_sample_size)).alias("size"))
    return fd.calibrate(fd.fit_frechet(reference, FRECHET), sizes).withColumn("threshold", F.round("threshold", 6))


@query()
def driftlens_score(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    _, reference, _ = _split(vectors)
    return fd.driftlens_score(vectors, fd.fit_frechet(reference, FRECHET))


# The detector on a plane: every vector becomes the sums of its two halves. With two components the trace of the matrix
# root is closed (Tr sqrt(M) = sqrt(Tr M + 2 sqrt(det M))) and the distance does not depend on the axes, so SQL states the
# whole way: split, baseline, pool order, draws by their formula, moments, distances, thresholds.
def slot_place(rows: str, span: str) -> str:
    """Place of slot j of a draw with digest `d` among `rows` rows, as `bootstrap.Draw` defines it; without a span rows may repeat."""
    k = [f"('0x' || substr(d, {i}, 8))::bigint" for i in (1, 9, 17, 25)]
    p = "2147483647"
    hashed = f"((({k[2]} % {p} * (j + 1) % {p} + {k[1]} % {p}) % {p} * (j + 1) + {k[0]} % {p}) % {p})"
    start, end = f"(j * {rows} // ({span}))", f"((j + 1) * {rows} // ({span}))"
    return f"({start} + {hashed} % ({end} - {start}) + {k[3]} % {rows}) % {rows}"


def _plane_distance() -> str:
    """From own moments n, mx, my (about the baseline's mean), a, b, c and the baseline's a0, b0, c0."""
    product = "(a * a0 + 2 * b * b0 + c * c0)"
    roots = "greatest((a * c - b * b) * (a0 * c0 - b0 * b0), 0)"
    return f"greatest(mx * mx + my * my + a + c + a0 + c0 - 2 * sqrt(greatest({product} + 2 * sqrt({roots}), 0)), 0)"


_MOMENTS = "count(*) as n, avg(x) as mx, avg(y) as my, covar_samp(x, x) as a, covar_samp(x, y) as b, covar_samp(y, y) as c"
_PLANE = f"""
with flat as (select window_id, post_id, list_sum(list_transform(embedding[1:len(embedding) // 2], lambda v: v::double)) as x,
    list_sum(list_transform(embedding[len(embedding) // 2 + 1:], lambda v: v::double)) as y from vectors),
  split as materialized (select *, row_number() over (order by {twin.order_key(42, "post_id", tie="post_id")}) <= round_even(count(*) over () * 0.5::double, 0) as held
    from flat where window_id in {FIRST}),
  base as materialized (select avg(x) as x0, avg(y) as y0, covar_samp(x, x) as a0, covar_samp(x, y) as b0, covar_samp(y, y) as c0 from split where not held),
  pool as materialized (select window_id, x - x0 as x, y - y0 as y, row_number() over (order by window_id, {KEYED}) - 1 as pos
    from split cross join base where held),
  groups as (select window_id, min(pos) as first, count(*) as n_rows from pool group by window_id),
  sizes as materialized (select distinct least(count(*), 1000, (select count(*) from pool)) as size from vectors group by window_id),
  eligible as (select size, first, n_rows, row_number() over (partition by size order by window_id) - 1 as turn, count(*) over (partition by size) as turns
    from sizes join groups on n_rows >= size),
  draws as (select s.size, draw, md5('42#' || s.size || '#' || draw) as d, coalesce(first, 0) as first, coalesce(n_rows, (select count(*) from pool)) as n_rows
    from sizes s cross join (select unnest(range(1000)) as draw) left join eligible e on e.size = s.size and e.turn = draw % turns),
  places as (select size, draw, first + {slot_place("n_rows", "size")} as pos from (select *, unnest(range(size)) as j from draws)),
  drawn as (select size, draw, {_MOMENTS} from places join pool using (pos) group by size, draw),
  scored as materialized (select size, draw, case when n > 1 then {_plane_distance()} end as statistic from drawn cross join base),
  limits as (select size, quantile_cont(statistic, 0.99) as threshold from scored where statistic is not null group by size)"""


def _plane_vectors(spark, sf_dir):
    half = F.floor(F.size("embedding") / 2).cast("int")
    def total(part):
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double"))
    halves = F.array(total(F.slice("embedding", F.lit(1), half)), total(F.slice("embedding", half + 1, F.size("embedding"))))
    return _vectors(spark, sf_dir).withColumn("embedding", halves)


def _plane_sizes(vectors, model):
    return vectors.groupBy("window_id").agg(F.least(
        F.count("*"), F.lit(FRECHET.window_sample_size), F.lit(model.pool.size)).alias("size"))


@query(sql=_PLANE + " select size, draw, round(statistic, 6) as statistic from scored")
def calibration_scores_plane(spark, sf_dir):
    """Every calibration draw of the plane detector, for every sample size that occurs."""
    vectors = _plane_vectors(spark, sf_dir)
    model = fd.fit_frechet(_split(vectors)[1], FRECHET)
    scores = fd.calibration_scores(model, _plane_sizes(vectors, model))
    return scores.withColumn("statistic", F.round(F.when(~F.isnan("statistic"), F.col("statistic")), 6))


@query(sql=_PLANE + " select size, round(threshold, 6) as threshold from limits")
def calibrate_plane(spark, sf_dir):
    vectors = _plane_vectors(spark, sf_dir)
    model = fd.fit_frechet(_split(vectors)[1], FRECHET)
    return fd.calibrate(model, _plane_sizes(vectors, model).filter("size >= 2")).withColumn("threshold", F.round("threshold", 6))


@query(sql=_PLANE + f""",
  sampled as (select window_id, x - x0 as x, y - y0 as y from (select *, row_number() over (partition by window_id order by {KEYED}) as rn from flat) cross join base
    where rn <= least(1000, (select count(*) from pool))),
  own as (select window_id, {_MOMENTS} from sampled group by window_id),
  measured as (select window_id, n, case when n > 1 then {_plane_distance()} end as score from own cross join base)
select window_id, round(score, 6) as driftlens_score, coalesce(score > threshold, false) as driftlens_alarm, round(threshold, 6) as threshold, n as n_used
from measured left join limits on size = n and n > 1""")
def driftlens_score_plane(spark, sf_dir):
    """Score, threshold and alarm of every window by the plane detector."""
    vectors = _plane_vectors(spark, sf_dir)
    return fd.driftlens_score(vectors, fd.fit_frechet(_split(vectors)[1], FRECHET))


@query("driftlens_used", sql=f"""
select window_id, least(least(n, 1000), pool) as n_used from (select window_id, count(*) as n from vectors group by window_id)
cross join (select cast(round_even(count(*) * 0.5::double, 0) as bigint) as pool from vectors where window_id in {FIRST})""")
def driftlens_used(spark, sf_dir):
    return driftlens_score(spark, sf_dir).select("window_id", "n_used")


@query(sql=f"""
select window_id, count(*) as n_rows from (select window_id, row_number() over (partition by window_id order by {KEYED}) as place, count(*) over (partition by window_id) as n
  from vectors where window_id in (select window_id from (select distinct window_id from vectors) order by window_id limit 10 offset 4))
where place <= least(round_even(n * 0.8::double, 0), 1000) group by window_id""")
def init_context(spark, sf_dir):
    """Rows of the initial context per reference window."""
    _, reference, _ = _split(_vectors(spark, sf_dir))
    return cd.init_context(cd.fit_concept(reference, CONCEPT)).groupBy("window_id").agg(F.count("*").alias("n_rows"))


@query()
def encode_sets(spark, sf_dir):
    """Concept vector of every window at its own sample size."""
    vectors = _vectors(spark, sf_dir)
    _, reference, stream = _split(vectors)
    model = cd.fit_concept(reference, CONCEPT)
    sets = cd.scoring_sets(stream, model)
    sizes = sets.groupBy("window_id").agg(F.array(F.count("*")).alias("sizes"))
    concepts = cd.encode_sets(sets, sizes, model)
    return concepts.select("window_id", "size", F.size("concept").alias("width"), F.round(F.array_max("concept"), 6).alias("largest"))


@query()
def calibrate_mcd(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    _, reference, stream = _split(vectors)
    model = cd.fit_concept(reference, CONCEPT)
    keys = cd.raw_scores(stream, model).select("size", "n_context")
    return cd.calibrate(model, keys).withColumn("threshold", F.round("threshold", 6))


# Sets of 11 (ten of context and the scored one) at a size for each way of drawing them: distinct windows, disjoint pooled
# sets, independent sets. The encoder is small and fixed, the draws and the discrepancy are those of the detector.
SMALL = cd.ConceptParams(hidden_dim=8, output_dim=4, n_encoders=2)
_SET_SCORES = f"""
with ref as materialized (select *, row_number() over (partition by window_id order by {KEYED}) as place, count(*) over (partition by window_id) as n
    from vectors where window_id in {FIRST}),
  scaler as materialized (select list(m order by i) as mu, list(s order by i) as sd from (select i, avg(x) as m, sqrt(var_pop(x)) + 1e-6 as s from (
    select unnest(embedding)::double as x, unnest(range(len(embedding))) as i from ref) group by i)),
  held as materialized (select window_id, row_number() over (order by window_id, {KEYED}) - 1 as pos,
    list_transform(range(len(embedding)), lambda i: (embedding[i + 1]::double - mu[i + 1]) / sd[i + 1]) as z
    from ref, scaler where place <= round_even(n * 0.8::double, 0)),
  item_w as materialized (select m, r, w, b from (select (select len(mu) from scaler) as d), lateral {fixed_weights(0, 2, 8, "d")}),
  features as materialized (select pos, m, r, greatest(0, list_inner_product(z, w) + b) as f from held, item_w),
  groups as materialized (select window_id, min(pos) as first, count(*) as n_rows from held group by window_id),
  wanted as (select distinct least(size, 1000) as size, t from (select min(n_rows) // 2 as size from groups union all
    select max(n_rows) // 2 + 1 from groups union all select count(*) // 11 + 1 from held) cross join (select count(*) as t from held)),
  regimes as materialized (select size, t, case when (select count(*) from groups where n_rows >= 2 * size) >= 11 then 'windows'
    when t >= 11 * size then 'disjoint' else 'independent' end as regime from wanted),
  draws as (select size, t, regime, draw, '42#' || size || '#10#' || draw as salt from regimes cross join (select unnest(range(500)) as draw)),
  large as (select size, first, n_rows, row_number() over (partition by size order by window_id) - 1 as e, count(*) over (partition by size) as n_e
    from regimes join groups on n_rows >= 2 * size where regime = 'windows'),
  picked as (select size, draw, salt, {slot_place("n_e", "11")} as e from (select size, draw, salt, n_e, md5(salt || '#windows') as d, unnest(range(11)) as j
    from draws join (select distinct size, n_e from large) using (size))),
  chosen as (select size, draw, salt, first, n_rows, row_number() over (partition by size, draw order by e) - 1 as s from picked join large using (size, e)),
  pooled_sets as (select *, unnest(range(11)) as s from draws where regime <> 'windows'),
  places as (
    select size, draw, s, first + {slot_place("n_rows", "size")} as pos from (select *, md5(salt || '#' || s) as d, unnest(range(size)) as j from chosen)
    union all select size, draw, s, {slot_place("t", "11 * size")} from (select size, draw, s, t, md5(salt) as d, s + 11 * unnest(range(size)) as j
      from pooled_sets where regime = 'disjoint')
    union all select size, draw, s, {slot_place("t", "size")} from (select size, draw, s, t, md5(salt || '#' || s) as d, unnest(range(size)) as j
      from pooled_sets where regime = 'independent')),
  pooled as (select size, draw, s, m, list(f order by r) as p from (
    select size, draw, s, m, r, avg(f) as f from places join features using (pos) group by all) group by all),
  {fixed_set_layers("size, draw, s", 8, 4, 2)},
  encoded as materialized (select size, draw, s, flatten(list(v order by m)) as v from concepts group by all),
  set_scores as (select a.size, a.draw, max(list_distance(a.v, b.v)) as statistic from encoded a join encoded b on a.size = b.size and a.draw = b.draw
    where b.s = 10 and a.s < 10 group by all)"""


def _small_model(spark, sf_dir):
    """Detector B with the small fixed encoder, and a key for each way of drawing."""
    _, reference, _ = _split(_vectors(spark, sf_dir))
    width = reference.select(F.size("embedding")).first()[0]
    model = cd.fit_concept(reference, SMALL, members=cd.fixed_members(width, SMALL))
    counts = model.pool.counts
    sizes = sorted({min(int(n), SMALL.scoring_sample_size) for n in (counts.min() // 2, counts.max() // 2 + 1, counts.sum() // 11 + 1)})
    return model, spark.createDataFrame([(n, SMALL.context_windows) for n in sizes], "size bigint, n_context bigint")


@query(sql=_SET_SCORES + " select size, 10::bigint as n_context, draw, round(statistic, 6) as statistic from set_scores")
def calibration_scores_mcd_fixed(spark, sf_dir):
    """Every calibration draw of detector B with a fixed encoder: distinct windows, disjoint sets, independent sets."""
    return cd.calibration_scores(*_small_model(spark, sf_dir)).withColumn("statistic", F.round("statistic", 6))


@query(sql=_SET_SCORES + " select size, 10::bigint as n_context, round(quantile_cont(statistic, 0.99), 6) as threshold from set_scores group by size")
def calibrate_mcd_fixed(spark, sf_dir):
    return cd.calibrate(*_small_model(spark, sf_dir)).withColumn("threshold", F.round("threshold", 6))


@query()
def mcd_score(spark, sf_dir):
    _, reference, stream = _split(_vectors(spark, sf_dir))
    return cd.mcd_score(stream, cd.fit_concept(reference, CONCEPT))


@query("mcd_set_sizes", sql=f"""
with sizes as (select window_id, least(case when window_id in {FIRST} then cast(round_even(count(*) * 0.8::double, 0) as bigint) else count(*) end, 1000) as n
    from vectors group by window_id),
  kept as (select *, window_id in {FIRST} as is_ref, row_number() over (order by window_id) as place from sizes
    where window_id not in (select window_id from (select distinct window_id from vectors) order by window_id limit 4))
select window_id, least(n, min(n) over w) as size, cast(count(*) over w as integer) as n_context from kept
window w as (order by place rows between 10 preceding and 1 preceding) qualify not is_ref""")
def mcd_set_sizes(spark, sf_dir):
    """Common set size and context length of every scored window."""
    _, reference, stream = _split(_vectors(spark, sf_dir))
    return cd.raw_scores(stream, cd.fit_concept(reference, CONCEPT)).select("window_id", "size", "n_context")


@query()
def train_encoder(spark, sf_dir):
    """Loss per training step of the ensemble on the reference."""
    _, reference, _ = _split(_vectors(spark, sf_dir))
    model = cd.fit_concept(reference, cd.ConceptParams())
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(model.losses)], "step int, loss double")


@query()
def score_windows(spark, sf_dir):
    """Score rows of both detectors for all windows."""
    vectors = _vectors(spark, sf_dir)
    reference, _, _ = _split(vectors)
    models_ = scoring.fit_detectors(vectors, reference, FRECHET, CONCEPT)
    return scoring.score_windows(vectors, reference, *models_).drop("processing_latency_ms", "throughput_posts_per_sec")


@query()
def score_windows_untrained(spark, sf_dir):
    """Score rows of both detectors, detector B without its training."""
    vectors = _vectors(spark, sf_dir)
    reference, _, _ = _split(vectors)
    models_ = scoring.fit_detectors(vectors, reference, FRECHET, cd.ConceptParams(train_epochs=0))
    return scoring.score_windows(vectors, reference, *models_).drop("processing_latency_ms", "throughput_posts_per_sec")


@query("score_windows_volumes", sql=f"""
select window_id, min(window_start) as window_start, count(*) as n_posts, window_id in {FIRST} as is_reference,
  window_id not in {FIRST} as has_second_score from vectors group by window_id""")
def score_windows_volumes(spark, sf_dir):
    """Volumes and flags of the score rows; detector B is NULL exactly on the reference."""
    return score_windows(spark, sf_dir).select("window_id", "window_start", "n_posts", "is_reference", F.col("mcddd_score").isNotNull().alias("has_second_score"))


@query("model_store", sql=f"select true as reused, false as other_model, false as other_reference, cast(count(*) as bigint) as n_pool from (select window_id, row_number() over (order by {twin.order_key(42, 'post_id', tie='post_id')}) as place, count(*) over () as n from vectors where window_id in {FIRST}) where place <= round_even(n * 0.5::double, 0)")
def model_store(spark, sf_dir):
    """A saved model is reused only for the same model name, reference and parameters."""
    _, reference, _ = _split(_vectors(spark, sf_dir))
    ids = [r["window_id"] for r in reference.select("window_id").distinct().collect()]       # 14 window ids
    path = scratch(spark, "model")
    models.save_frechet(fd.fit_frechet(reference, FRECHET), path, "given", ids)
    same = models.load_frechet_if_matching(spark, path, "given", ids, FRECHET)
    other = models.load_frechet_if_matching(spark, path, "another", ids, FRECHET)
    moved = models.load_frechet_if_matching(spark, path, "given", ids[1:], FRECHET)
    rows = same.pool.frame.agg(F.count("*").alias("n_pool"))
    return rows.select(F.lit(same is not None).alias("reused"), F.lit(other is not None).alias("other_model"),
                       F.lit(moved is not None).alias("other_reference"), "n_pool")

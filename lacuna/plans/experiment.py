"""Whole runs: hide, impute, score."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, functions as F

from lacuna.functions.text import MASK_TOKEN, MAX_TOKENS, encode_rows
from lacuna.operators import ampute as A
from lacuna.operators import coding, fidelity, utility
from lacuna.functions.holes import nan_as_null, q
from lacuna.operators.cells import apply_mask, assert_no_holes, mask_table
from lacuna.operators.embed import HashEncoder, embed_text, hash_vectors, hashed_fields
from lacuna.operators.impute import fill_table
from lacuna.operators.learn import learn_metric, tune_metric
from lacuna.operators.pairs import contrastive_pairs
from lacuna.operators.split import train_test_split
from lacuna.roles import Roles
from lacuna.scratch import cut, cut_spread
from lacuna.sources.tables import cache_path, cached_embeddings, write_metrics

METRIC_NAMES = ("smape", "error", "asmape", "kl", "base_cls", "imputed_cls", "model_selection", "feature_selection")


@dataclass(frozen=True)
class Settings:
    """Defaults of the published experiments."""

    seed: int = 0
    test_size: float = 0.2
    missing_type: str = "MAR"
    missing_rate: float = 0.3
    k: int = 5
    metric: str = "cosine"
    encoding: str = "tab2text"
    batch_size: int = 16
    token: str = MASK_TOKEN
    encoder: HashEncoder = field(default_factory=HashEncoder)


@dataclass(frozen=True)
class Prepared:
    """Coded tables of a run. ``truth`` is the training part before cells were hidden."""

    truth: DataFrame
    test: DataFrame
    mask: DataFrame
    holed: DataFrame
    dimension: DataFrame
    types: dict


def prepare(df: DataFrame, roles: Roles, settings: Settings = Settings()) -> Prepared:
    """Code categories over all rows, split, and hide cells of the training part."""
    df = nan_as_null(df, roles.features)
    types = {f: df.schema[f].dataType for f in roles.features}
    dimension = coding.build_dimension(df, roles.categorical)
    coded, _ = cut_spread(coding.encode(df, dimension, roles.categorical).select(roles.key, *[q(f) for f in roles.features]), "coded")
    train, test = train_test_split(coded, roles, settings.test_size, settings.seed)
    hidden = A.hidden_cells(train, roles, settings.missing_type, settings.missing_rate, settings.seed)
    # one written table holds the truth and the mask; the holed table is a projection of it
    flags = {f: F.coalesce(c, F.lit(False)).alias(f"hide {f}") for f, c in hidden.items()}
    marked = cut(train.select(roles.key, *[q(f) for f in roles.features], *flags.values()), "marked")
    shown = {f: q(f"hide {f}") for f in flags}
    truth = marked.select(roles.key, *[q(f) for f in roles.features])
    holed = apply_mask(marked, shown).select(roles.key, *[q(f) for f in roles.features])
    return Prepared(truth, test, mask_table(marked, roles, shown), holed, dimension, types)


def row_vectors(ready: Prepared, roles: Roles, settings: Settings, make_encoder=None, kept: str | None = None) -> DataFrame:
    """The holed table with vectors: from a user's text encoder, or from the hashing encoder. ``kept``: see ``embed_text``."""
    if make_encoder is None:
        return hash_vectors(ready.holed, roles, settings.encoder)
    texts = encode_rows(_shown(ready, roles), roles, settings.encoding, token=settings.token)
    return ready.holed.join(embed_text(texts, "text", make_encoder, settings.batch_size, kept=kept), roles.key)


def _shown(ready: Prepared, roles: Roles) -> DataFrame:
    """The holed table with its categories in words."""
    return coding.decode(ready.holed, ready.dimension, roles.categorical, ready.types)


def tuned_vectors(ready: Prepared, roles: Roles, settings: Settings, make_encoder=None, kept: str | None = None,
                  epochs: int | None = None, losses: str | None = None) -> DataFrame:
    """As ``row_vectors``, scaled by a metric learned from contrastive triples of the holed rows' texts.

    Without an encoder the texts are hashed field by field. With ``epochs`` the metric is fitted by gradient steps, every epoch drawing
    its triples anew, and the loss of each is written to ``losses``; otherwise one set of triples is fitted to the end.
    """
    make_encoder = make_encoder or hashed_fields(settings.encoder.dim)

    def triples(epoch: int) -> DataFrame:
        made = contrastive_pairs(_shown(ready, roles), roles, settings.encoding, token=settings.token, seed=settings.seed, batch_size=settings.batch_size, epoch=epoch)
        for text, out in (("anchor", "h_x"), ("positive", "h_pos"), ("negative", "h_neg")):
            made = embed_text(made, text, make_encoder, settings.batch_size, out, distinct=False)
        return made

    vectors = row_vectors(ready, roles, settings, make_encoder, kept)
    if epochs is None:
        learned = learn_metric(cut(triples(0).select("h_x", "h_pos", "h_neg"), "triples"))
    else:
        vectors = cut(vectors, "vectors")
        dim = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
        learned, record = tune_metric(vectors.sparkSession, triples, dim, epochs)
        if losses is not None:
            write_metrics(record, losses)
    return learned.scale(vectors, "vec")


def fingerprint(df: DataFrame, roles: Roles) -> list[str]:
    """Row count and two order-free digests of the key and features."""
    row = F.xxhash64(q(roles.key), *[q(f) for f in roles.features])
    seen = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(20,0)"))).first()
    return [str(v) for v in seen]


def evaluate(imputed: DataFrame, truth: DataFrame, test: DataFrame, mask: DataFrame, roles: Roles,
             models=utility.MODELS, seed: int = 0, **limits) -> DataFrame:
    """The eight measures of an imputed table; one row. ``limits`` of the models: see ``utility.estimators``."""
    errors = fidelity.cell_errors(truth, imputed, mask, roles).first()
    kl = fidelity.kl_mean(truth, imputed, roles).first()["kl"]
    scores = utility.classification(truth, test, imputed, roles, models, seed, **limits)
    row = (errors["smape"], errors["error"], errors["asmape"], kl, scores["base_cls"], scores["imputed_cls"],
           scores["model_selection"], scores["feature_selection"])
    return imputed.sparkSession.createDataFrame(
        [tuple(None if v is None else float(v) for v in row)], ", ".join(f"{n} double" for n in METRIC_NAMES))


def experiment(df: DataFrame, roles: Roles, settings: Settings = Settings(), make_encoder=None,
               models=utility.MODELS, tune: bool = False, cache: str | None = None, encoder_name: str | None = None,
               epochs: int | None = None, losses: str | None = None, **limits) -> DataFrame:
    """Hide cells of a complete table, fill them, and score the result.

    ``tune`` learns a metric from contrastive triples first, with ``epochs`` by gradient steps whose losses go to the table ``losses``.
    ``cache`` names a folder that keeps vectors. Those of an encoder of the user's own, which needs a name for that, are kept text by text, so
    another seed, rate or mechanism encodes only texts it has not seen; other vectors are kept under a key of everything that
    shapes them: data, roles, all settings, tuning and encoder. ``limits`` of the models: see ``utility.estimators``.
    """
    if cache and make_encoder is not None and not encoder_name:
        raise ValueError("a cached encoder needs a name")
    ready = prepare(df, roles, settings)

    kept = cache_path(cache, {"encoder": encoder_name, "limit": MAX_TOKENS}) if cache and make_encoder is not None else None

    def compute():
        if tune:
            return tuned_vectors(ready, roles, settings, make_encoder, kept, epochs, losses)
        return row_vectors(ready, roles, settings, make_encoder, kept)

    if cache and kept is None:
        shape = {"settings": asdict(settings), "roles": asdict(roles), "tune": tune, "epochs": epochs, "encoder": settings.encoder.settings(),
                 "data": fingerprint(df, roles)}
        stored = cached_embeddings(df.sparkSession, cache, shape, roles.key, "vec", compute)
        vectors = ready.holed.join(stored, roles.key)
    else:
        vectors = compute()
    imputed = cut(fill_table(vectors, roles, "vec", settings.k, settings.metric), "imputed")
    assert_no_holes(imputed, roles.features)
    return evaluate(imputed, ready.truth, ready.test, ready.mask, roles, models, settings.seed, **limits)

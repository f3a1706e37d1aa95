"""Features, models and forecasts.

Forecast models are stored under a key of the data's version and their settings, and looked up before
any fit. Values are checked with least squares on two numbers, which SQL can solve too; scoring does not
depend on the kind of model. Fits on all nine inputs have no SQL twin: SQL checks the rows they score
(``..._shape``), numpy their coefficients, and the same flows on two inputs (``..._two_inputs``) their values.
"""

from __future__ import annotations

import threading
from weakref import WeakKeyDictionary

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.operators import features as X
from fiscus.operators import forecast as C
from fiscus.operators import joins as J
from fiscus.operators import metrics as R
from fiscus.operators import models as M
from fiscus.operators.aggregates import payer_year_summary
from fiscus.plans.catalogue import question
from fiscus.plans.relational import PAYERS_BY_TYPE_SQL
from fiscus.plans.rule_checks import KEYS, KEYS_SQL, SEASON_SQL, facts_of_payers
from fiscus.schemas import MEASURES
from fiscus.session import materialize, shared_folder
from fiscus.sources import metadata
from fiscus.sources.store import Store
from fiscus.sources.warehouse import Warehouse

ONE_INN = "100000000007"

_FITTED: WeakKeyDictionary[Warehouse, dict[str, object]] = WeakKeyDictionary()
_TRAINING: WeakKeyDictionary[Warehouse, DataFrame] = WeakKeyDictionary()
_FITTING = threading.RLock()


def fitted(db: Warehouse, name: str, make):
    """Fit once per run of a question, so that data that changed is never scored with an old model."""
    with _FITTING:
        own = _FITTED.setdefault(db, {})
        if name not in own:
            own[name] = make()
        return own[name]


def training(db: Warehouse) -> DataFrame:
    """The stored model input; one per run, as stored tables are not kept between runs."""
    with _FITTING:
        if db not in _TRAINING:
            _TRAINING[db] = M.training_input(db.stored_facts, db.taxpayer, db.stored_econ)
        return _TRAINING[db]


FORECAST_ALPHA = 1.0
LINES = {"income": ["yr", "mon"], "transactions": ["yr", "mon"], "tax": ["yr", "mon"]}


def plain_rows(db: Warehouse) -> DataFrame:
    doubles = {m: F.col(m).cast("double") for m in MEASURES}
    return db.stored_facts.select(*KEYS, *MEASURES).withColumns(doubles)


def forecast_model(db: Warehouse) -> PipelineModel:
    """A line in year and month for each target."""
    return Store(db.spark).model("lines", [db.folder, db.version, LINES], lambda: M.fit_lines(plain_rows(db), LINES))


def full_model(db: Warehouse) -> PipelineModel:
    """Ridge on all nine inputs for each target."""
    settings = [db.folder, db.version, X.NUMERIC, X.CATEGORICAL, FORECAST_ALPHA]
    return Store(db.spark).model("ridge", settings, lambda: M.fit_forecast_lines(M.training_input(db.stored_facts, db.taxpayer), FORECAST_ALPHA))


def trees_model(db: Warehouse) -> PipelineModel:
    """Boosted trees on all nine inputs for each target, learned from the training rows."""
    settings = [db.folder, db.version, X.NUMERIC, X.CATEGORICAL, M.TREES, M.TREE_DEPTH, M.LEARNING_RATE, M.SEED]
    return Store(db.spark).model("trees", settings, lambda: M.fit_forecast(X.split_train_test(training(db))[0]))


def line_sql(rows: str, label: str, x: str, z: str, name: str) -> str:
    """One row of level and two slopes of the least-squares plane of ``label`` over ``x`` and ``z``."""
    return f"""{name} as (
      select my - s1 * mx - s2 * mz as level, s1, s2 from (
        select (d * p - b * q) / (a * d - b * b) as s1, (a * q - b * p) / (a * d - b * b) as s2, mx, mz, my from (
          select covar_pop({x}, {x}) as a, covar_pop({x}, {z}) as b, covar_pop({z}, {z}) as d,
            covar_pop({x}, {label}) as p, covar_pop({z}, {label}) as q,
            avg({x}) as mx, avg({z}) as mz, avg({label}) as my from ({rows}))))"""


PLAIN_SQL = """select cast(yr as double) as yr, cast(mon as double) as mon, cast(income as double) as income,
    cast(transactions as double) as transactions, cast(tax as double) as tax from monthly_tax"""
LINES_SQL = ", ".join(line_sql(PLAIN_SQL, m, "yr", "mon", f"line_{m}") for m in MEASURES)


def predicted_sql(label: str, digits: int) -> str:
    line = f"line_{label}"
    return f"round_even(greatest({line}.level + {line}.s1 * yr + {line}.s2 * mon, 0), {digits})"


def grid_sql(payers: str) -> str:
    """Twelve predicted months for each row of ``payers``, which has the year."""
    return f"""select g.*, {predicted_sql('income', 2)} as predicted_income,
        cast({predicted_sql('transactions', 0)} as bigint) as predicted_transactions,
        {predicted_sql('tax', 2)} as predicted_tax
      from (select p.*, cast(months.mon as int) as mon, {SEASON_SQL.replace('mon ', 'months.mon ')} as season
        from ({payers}) p, (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) months(mon)) g,
        line_income, line_transactions, line_tax"""


GRID_SQL = grid_sql(f"select *, cast((select max(yr) from monthly_tax) + 1 as int) as yr from ({PAYERS_BY_TYPE_SQL})")
OWN_YEAR_SQL = grid_sql(f"""select *, cast((select max(yr) from monthly_tax o where o.taxpayer_id = r.taxpayer_id) + 1 as int) as yr
    from ({PAYERS_BY_TYPE_SQL}) r""")


def coming_year(db: Warehouse) -> int:
    return max(metadata.stored_years(db.spark, db.facts_folder)) + 1


def payers_of(db: Warehouse) -> DataFrame:
    return J.payers_by_tax_type(db.stored_facts, db.taxpayer)


# ------------------------------------------------------------------ features


@question("train_test_split", f"""
    select {KEYS_SQL}, md5(concat_ws('|', '42', taxpayer_id, yr, mon, tax_type)) < 'cccccccc'
      as in_train from monthly_tax""", views="monthly_tax")
def train_test_split(db: Warehouse) -> DataFrame:
    train, test = X.split_train_test(db.monthly_tax.select(*KEYS))
    return train.withColumn("in_train", F.lit(True)).unionByName(
        test.withColumn("in_train", F.lit(False))
    )


@question("impute_mode", """
    with counts as (
      select 'taxpayer_type' as feature, taxpayer_type as value, count(*) as n from taxpayer
        group by all
      union all select 'activity_type', activity_type, count(*) from taxpayer group by all
      union all select 'registration_district', registration_district, count(*) from taxpayer
        group by all
      union all select 'employees_count', cast(employees_count as string), count(*) from taxpayer
        where employees_count is not null group by all)
    select feature, value, n from counts
    qualify row_number() over (partition by feature order by n desc, value) = 1""",
    views="taxpayer")
def impute_mode(db: Warehouse) -> DataFrame:
    return X.most_frequent(
        db.taxpayer, ["taxpayer_type", "activity_type", "registration_district", "employees_count"]
    )


@question("impute_median", f"""
    select m.taxpayer_id, m.yr, m.mon, m.tax_type, coalesce(employees_count,
        (select median(employees_count) from monthly_tax m
         join taxpayer t on m.taxpayer_id = t.taxpayer_id)) as employees_count,
      coalesce(cpi_yoy, (select median(cpi_yoy) from monthly_tax m
         left join econ e on m.yr = e.yr and m.mon = e.mon)) as cpi_yoy
    from monthly_tax m join taxpayer t on m.taxpayer_id = t.taxpayer_id
    left join econ e on m.yr = e.yr and m.mon = e.mon""", views="monthly_tax taxpayer econ")
def impute_median(db: Warehouse) -> DataFrame:
    rows = training(db)
    values = X.median_fills(rows, ["employees_count", "cpi_yoy"])
    return X.fill_doubles(rows, values).select(*KEYS, "employees_count", "cpi_yoy")


@question("onehot_ignore_unknown", """
    select taxpayer_id, nullif(activity_type, 'EUROPE') as activity,
      case when activity_type = 'EUROPE' then 0.0e0 else 1.0e0 end as active
    from taxpayer""", views="taxpayer")
def onehot_ignore_unknown(db: Warehouse) -> DataFrame:
    seen = db.taxpayer.where(F.col("activity_type") != "EUROPE")
    stages = X.feature_stages(seen, ["activity_type"], [], fills="constant")
    model = Pipeline(stages=stages).fit(seen)
    names = F.array(*[F.lit(n.removeprefix("activity_type_"))
                      for n in X.feature_names(model, ["activity_type"], [])])
    flags = vector_to_array(X.FEATURES)
    position = F.array_position(flags, F.lit(1.0)).cast("int")
    return model.transform(db.taxpayer.select("taxpayer_id", "activity_type")).select(
        "taxpayer_id",
        F.when(position > 0, F.try_element_at(names, position)).alias("activity"),
        F.aggregate(flags, F.lit(0.0), lambda total, x: total + x).alias("active"),
    )


@question("standardize", f"""
    select {KEYS_SQL},
      round((cast(income as double) - avg(cast(income as double)) over ())
        / stddev_pop(cast(income as double)) over (), 6) as income,
      round((mon - avg(mon) over ()) / stddev_pop(mon) over (), 6) as mon_scaled
    from monthly_tax""", views="monthly_tax")
def standardize(db: Warehouse) -> DataFrame:
    rows = db.monthly_tax.withColumn("mon_scaled", F.col("mon"))
    scaled = X.standardize(rows, ["income", "mon_scaled"])
    return scaled.select(
        *KEYS, F.round("income", 6).alias("income"), F.round("mon_scaled", 6).alias("mon_scaled")
    )


@question("assemble_features", f"""
    select m.taxpayer_id, yr, mon, tax_type, cast(yr + mon + cast(has_employees as int) as double)
        + coalesce(employees_count, (select median(employees_count) from monthly_tax m
           join taxpayer t on m.taxpayer_id = t.taxpayer_id)) + 5 as total,
      cast((select 4 + 4 + count(distinct tax_type) + count(distinct taxpayer_type)
        + count(distinct activity_type) + count(distinct registration_district)
        from monthly_tax m join taxpayer t on m.taxpayer_id = t.taxpayer_id) as int) as width
    from monthly_tax m join taxpayer t on m.taxpayer_id = t.taxpayer_id""",
    views="monthly_tax taxpayer")
def assemble_features(db: Warehouse) -> DataFrame:
    rows = training(db)
    model = Pipeline(stages=X.feature_stages(rows)).fit(rows)
    values = vector_to_array(X.FEATURES)
    return model.transform(rows).select(
        *KEYS,
        F.aggregate(values, F.lit(0.0), lambda total, x: total + x).alias("total"),
        F.size(values).alias("width"),
    )


# ------------------------------------------------------------------ models


def quality(db: Warehouse, model: PipelineModel, labels=MEASURES) -> DataFrame:
    test = X.split_train_test(training(db))[1]
    return R.regression_metrics(M.labelled_predictions(model, test, labels), by=["target"])


@question("gbt_train")
def gbt_train(db: Warehouse) -> DataFrame:
    return quality(db, trees_model(db))


@question("ridge_train")
def ridge_train(db: Warehouse) -> DataFrame:
    train = X.split_train_test(training(db))[0]
    model = fitted(db, "ridge", lambda: M.fit_best_ridge(train))
    return quality(db, model, ["transactions"])


RIDGE_SQL = """
    with rows as (select cast(income as double) / 1000 as x1, cast(mon as double) as x2,
        cast(transactions as double) as y from monthly_tax),
    s as (select covar_pop(x1, x1) * count(*) + 50 as a, covar_pop(x1, x2) * count(*) as b,
        covar_pop(x2, x2) * count(*) + 50 as d, covar_pop(x1, y) * count(*) as p,
        covar_pop(x2, y) * count(*) as q from rows)
    select 'income' as feature, round((d * p - b * q) / (a * d - b * b), 5) as coefficient from s
    union all
    select 'mon', round((a * q - b * p) / (a * d - b * b), 5) from s"""


@question("ridge_closed_form", RIDGE_SQL, views="monthly_tax")
def ridge_closed_form(db: Warehouse) -> DataFrame:
    rows = materialize(
        db.monthly_tax.select(
            (F.col("income").cast("double") / 1000).alias("income"),
            F.col("mon"),
            F.col("transactions").cast("double").alias("transactions"),
            F.lit("all").alias("kind"),
        ),
        "ridge-rows",
    )
    strength = M.ridge_strength(rows, "transactions")
    model = M.fit_targets(
        rows, [M.ridge("transactions", 50.0 * strength)], categorical=["kind"], numeric=["income", "mon"]
    )
    table = M.coefficients(model, db.spark, ["income", "mon"], ["kind"])
    found = table.where(F.col("feature").isin("income", "mon"))
    return found.withColumn("coefficient", F.round("coefficient", 5))


@question("grid_search_cv")
def grid_search_cv(db: Warehouse) -> DataFrame:
    return M.search_ridge(X.split_train_test(training(db))[0])


def income_inputs() -> list[str]:
    return [*X.NUMERIC, *M.ECON]


def chained_models(db: Warehouse):
    def make():
        train = X.split_train_test(training(db))[0]
        return (
            M.fit_log_target(train, "income", income_inputs()),
            M.fit_log_target(train, "transactions", [*income_inputs(), "income"]),
            M.fit_tax(train, [*income_inputs(), "income", "transactions"]),
        )

    return fitted(db, "chained", make)


@question("log_target_train")
def log_target_train(db: Warehouse) -> DataFrame:
    test = X.split_train_test(training(db))[1]
    income, transactions, _ = chained_models(db)
    sets = M.labelled_predictions(income, test, ["income"]).unionByName(
        M.labelled_predictions(transactions, test, ["transactions"])
    )
    return R.regression_metrics(M.cut_actuals(sets), by=["target"])


@question("tax_train_full_features")
def tax_train_full_features(db: Warehouse) -> DataFrame:
    return quality(db, chained_models(db)[2], ["tax"])


@question("coefficient_table")
def coefficient_table(db: Warehouse) -> DataFrame:
    train = X.split_train_test(training(db))[0]
    model = fitted(db, "ridge", lambda: M.fit_best_ridge(train))
    return M.coefficients(model, db.spark, M.ridge_inputs(train))


@question("sort_by_abs")
def sort_by_abs(db: Warehouse) -> DataFrame:
    return M.strongest_first(coefficient_table(db), M.ECON)


@question("sort_by_abs_growth", """
    select taxpayer_id, yr, mon, tax_type, cast(income as double) - 100000 as coefficient
    from monthly_tax where tax_type in ('1-URGENT', '5-LOW')
    order by abs(cast(income as double) - 100000) desc""", views="monthly_tax")
def sort_by_abs_growth(db: Warehouse) -> DataFrame:
    rows = db.monthly_tax.select(
        *KEYS, F.col("tax_type").alias("feature"),
        (F.col("income").cast("double") - 100000).alias("coefficient"),
    )
    return M.strongest_first(rows, ["1-URGENT", "5-LOW"]).drop("feature")


@question("model_save_load", f"""
    select 'all' as compared, count(*) as n_rows, cast(0 as bigint) as n_different
    from monthly_tax""", views="monthly_tax")
def model_save_load(db: Warehouse) -> DataFrame:
    path = shared_folder(db.spark, "model")
    model = forecast_model(db)
    M.save_model(model, path)
    again = M.load_model(path)
    names = [f"predicted_{m}" for m in MEASURES]
    # Score one after the other on the same row, so no join is needed to compare.
    rows = plain_rows(db)
    first = model.transform(rows).select(
        *rows.columns, *[F.col(n).alias(f"first_{n}") for n in names]
    )
    differs = F.lit(False)
    for n in names:
        differs = differs | (F.col(n) != F.col(f"first_{n}"))
    return again.transform(first).agg(
        F.lit("all").alias("compared"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(differs).alias("n_different"),
    )


# The same flows on two numeric inputs, for which SQL can solve the systems too.

TWO_INPUTS = {"numeric": ("mon", "income"), "categorical": ()}

SPLIT_SQL = """select *, md5(concat_ws('|', '42', taxpayer_id, yr, mon, tax_type)) < 'cccccccc' as in_train,
    cast('0x' || substr(md5(concat_ws('|', '43', taxpayer_id, yr, mon, tax_type)), 1, 8) as bigint) % 5 as fold
  from (select taxpayer_id, tax_type, yr, mon, cast(income as double) as income,
    cast(transactions as double) as transactions, cast(tax as double) as tax from monthly_tax)"""


def penalised_sql(rows: str, by: str) -> str:
    """Level and slopes of the ridge plane of ``y`` over ``x1`` and ``x2`` for each ``alpha`` and ``by``."""
    return f"""select *, my - s1 * mx1 - s2 * mx2 as level from (
      select *, (d * (1 + alpha / n) * p - b * q) / (a * d * (1 + alpha / n) * (1 + alpha / n) - b * b) as s1,
        (a * (1 + alpha / n) * q - b * p) / (a * d * (1 + alpha / n) * (1 + alpha / n) - b * b) as s2
      from (select {by}, count(*) as n, avg(x1) as mx1, avg(x2) as mx2, avg(y) as my,
          covar_pop(x1, x1) as a, covar_pop(x1, x2) as b, covar_pop(x2, x2) as d,
          covar_pop(x1, y) as p, covar_pop(x2, y) as q
        from ({rows}) group by {by}),
      (select unnest([{', '.join(f'{a}::double' for a in M.ALPHAS)}]) as alpha))"""


HELD_OUT_SQL = f"""train as (select mon as x1, income as x2, transactions as y, fold from ({SPLIT_SQL}) where in_train),
    planes as ({penalised_sql('select t.*, k from train t, range(5) folds(k) where t.fold <> k', 'k')}),
    scores as (select alpha, k, 1 - sum((y - level - s1 * x1 - s2 * x2) ** 2) / (var_pop(y) * count(*)) as r2
      from train join planes on fold = k group by alpha, k),
    found as (select alpha, avg(r2) as mean_r2 from scores group by alpha),
    whole as (select * from ({penalised_sql('select *, 0 as k from train', 'k')})
      where alpha = (select arg_max(alpha, mean_r2) from found))"""


def metrics_sql(target: str, actual: str, predicted: str, rows: str) -> str:
    return f"""select '{target}' as target, round(avg(abs(y - z)), 4) as mae, round(sqrt(avg((y - z) ** 2)), 4) as rmse,
      round(1 - sum((y - z) ** 2) / (var_pop(y) * count(*)), 8) as r2,
      round(avg(case when y <> 0 then abs(y - z) / abs(y) end) * 100, 4) as mape,
      round(median(abs(y - z)), 4) as median_ae, round(max(abs(y - z)), 4) as max_error, count(*) as observations
    from (select {actual} as y, {predicted} as z from {rows})"""


def rounded_metrics(sets: DataFrame) -> DataFrame:
    """Without the mean square, which the root says already, in as many digits as any order of sums gives."""
    found = R.regression_metrics(sets, by=["target"]).drop("mse")
    names = ("mae", "rmse", "mape", "median_ae", "max_error")
    return found.withColumns({c: F.round(c, 4) for c in names} | {"r2": F.round("r2", 8)})


def split_rows(db: Warehouse) -> tuple[DataFrame, DataFrame]:
    return X.split_train_test(fitted(db, "plain-rows", lambda: plain_rows(db)))


def two_input_ridge(db: Warehouse) -> PipelineModel:
    return fitted(db, "ridge-2", lambda: M.fit_best_ridge(split_rows(db)[0], **TWO_INPUTS))


@question("grid_search_two_inputs", f"""
    with {HELD_OUT_SQL}
    select alpha, round(mean_r2, 8) as mean_r2, alpha = (select arg_max(alpha, mean_r2) from found) as best from found""",
    views="monthly_tax")
def grid_search_two_inputs(db: Warehouse) -> DataFrame:
    found = M.search_ridge(split_rows(db)[0], **TWO_INPUTS)
    return found.withColumn("mean_r2", F.round("mean_r2", 8))


@question("ridge_train_two_inputs", f"""
    with {HELD_OUT_SQL}
    {metrics_sql('transactions', 'transactions', 'level + s1 * mon + s2 * income',
                 f'({SPLIT_SQL}), whole where not in_train')}""", views="monthly_tax")
def ridge_train_two_inputs(db: Warehouse) -> DataFrame:
    return rounded_metrics(M.labelled_predictions(two_input_ridge(db), split_rows(db)[1], ["transactions"]))


@question("coefficient_table_two_inputs", f"""
    with {HELD_OUT_SQL}
    select feature, round(coefficient, 5) as coefficient from (
      select 'mon' as feature, s1 * sqrt(a) as coefficient from whole
      union all select 'income', s2 * sqrt(d) from whole)""", views="monthly_tax")
def coefficient_table_two_inputs(db: Warehouse) -> DataFrame:
    table = M.coefficients(two_input_ridge(db), db.spark, **TWO_INPUTS)
    return table.withColumn("coefficient", F.round("coefficient", 5))


LOGGED_SQL = f"""train as (select *, ln(1 + least(greatest(income, 5000), 500000)) as log_income,
      ln(1 + least(greatest(transactions, 0), 500)) as log_transactions from ({SPLIT_SQL}) where in_train),
    test as (select * from ({SPLIT_SQL}) where not in_train)"""


@question("log_target_two_inputs", f"""
    with {LOGGED_SQL}, {line_sql('from train', 'log_income', 'yr', 'mon', 'line_income')},
    {line_sql('from train', 'log_transactions', 'mon', 'income', 'line_transactions')}
    {metrics_sql('income', 'least(greatest(income, 5000), 500000)', 'exp(level + s1 * yr + s2 * mon) - 1',
                 'test, line_income')}
    union all
    {metrics_sql('transactions', 'least(greatest(transactions, 0), 500)', 'exp(level + s1 * mon + s2 * income) - 1',
                 'test, line_transactions')}""", views="monthly_tax")
def log_target_two_inputs(db: Warehouse) -> DataFrame:
    train, test = split_rows(db)
    income = M.fit_log_line(train, "income", ["yr", "mon"])
    transactions = M.fit_log_line(train, "transactions", ["mon", "income"])
    sets = M.labelled_predictions(income, test, ["income"]).unionByName(
        M.labelled_predictions(transactions, test, ["transactions"])
    )
    return rounded_metrics(M.cut_actuals(sets))


@question("tax_train_two_inputs", f"""
    with {LOGGED_SQL}, {line_sql('from train', 'tax', 'income', 'transactions', 'line_tax')}
    {metrics_sql('tax', 'tax', 'level + s1 * income + s2 * transactions', 'test, line_tax')}""", views="monthly_tax")
def tax_train_two_inputs(db: Warehouse) -> DataFrame:
    train, test = split_rows(db)
    model = M.fit_lines(train, {"tax": ["income", "transactions"]})
    return rounded_metrics(M.labelled_predictions(model, test, ["tax"]))


# ------------------------------------------------------------------ forecasts


@question("score_grid", f"with {LINES_SQL} {GRID_SQL}", views="monthly_tax taxpayer")
def score_grid(db: Warehouse) -> DataFrame:
    return C.score_grid(forecast_model(db), payers_of(db), coming_year(db))


SHAPE_SQL = f"""
    select taxpayer_id, tax_type, cast(2001 as int) as yr, count(*) as n_months,
      cast(sum(cast(1 as int)) as bigint) as n_valid,
      string_agg(distinct season, ',' order by season) as seasons
    from (select p.*, {SEASON_SQL} as season from ({PAYERS_BY_TYPE_SQL}) p,
      (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) months(mon))
    group by taxpayer_id, tax_type"""


def shape(monthly: DataFrame, *names: str) -> DataFrame:
    """Months per payer and regime, and how many carry sensible predictions."""
    valid = F.lit(True)
    for n in names:
        valid = valid & (F.col(n) >= 0) & ~F.isnan(n)
    return monthly.groupBy("taxpayer_id", "tax_type", "yr").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.count_if(valid).alias("n_valid"),
        F.array_join(F.array_sort(F.collect_set("season")), ",").alias("seasons"),
    )


@question("score_grid_shape", SHAPE_SQL, views="monthly_tax taxpayer")
def score_grid_shape(db: Warehouse) -> DataFrame:
    return shape(C.score_grid(full_model(db), payers_of(db), coming_year(db)), *C.PREDICTED)


@question("score_grid_yearly", f"""
    with {LINES_SQL} select taxpayer_id, full_name, inn, yr, round(sum(predicted_income), 2) as total_predicted_income,
      cast(sum(predicted_transactions) as bigint) as total_predicted_transactions,
      round(sum(predicted_tax), 2) as total_predicted_tax
    from ({GRID_SQL}) group by taxpayer_id, full_name, inn, yr""", views="monthly_tax taxpayer")
def score_grid_yearly(db: Warehouse) -> DataFrame:
    yearly = C.yearly_forecast(score_grid(db))
    return yearly.withColumns({c: F.round(c, 2) for c in ("total_predicted_income", "total_predicted_tax")})


CHAIN_ROWS_SQL = f"""select *, ln(1 + least(greatest(income, 5000), 500000)) as log_income,
    ln(1 + least(greatest(transactions, 0), 500)) as log_transactions from ({PLAIN_SQL})"""


@question("score_chained", f"""
    with {line_sql(CHAIN_ROWS_SQL, 'log_income', 'yr', 'mon', 'line_income')},
    {line_sql(CHAIN_ROWS_SQL, 'log_transactions', 'mon', 'income', 'line_transactions')},
    {line_sql(CHAIN_ROWS_SQL, 'tax', 'income', 'transactions', 'line_tax')},
    one as (select g.*, exp(level + s1 * yr + s2 * mon) - 1 as predicted_income from (
      select p.*, cast((select max(yr) from monthly_tax) + 1 as int) as yr, cast(months.mon as int) as mon,
        {SEASON_SQL.replace('mon ', 'months.mon ')} as season from ({PAYERS_BY_TYPE_SQL}) p,
        (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) months(mon)) g, line_income),
    two as (select one.*, exp(level + s1 * mon + s2 * predicted_income) - 1 as predicted_transactions from one, line_transactions),
    three as (select two.*, level + s1 * predicted_income + s2 * predicted_transactions as predicted_tax from two, line_tax)
    select * exclude (predicted_income, predicted_transactions, predicted_tax), round(predicted_income, 3) as predicted_income,
      round(predicted_transactions, 5) as predicted_transactions, round(predicted_tax, 3) as predicted_tax from three""",
    views="monthly_tax taxpayer")
def score_chained(db: Warehouse) -> DataFrame:
    rows = fitted(db, "chain-rows", lambda: plain_rows(db))
    models = (
        M.fit_log_line(rows, "income", ["yr", "mon"]), M.fit_log_line(rows, "transactions", ["mon", "income"]),
        M.fit_lines(rows, {"tax": ["income", "transactions"]}),
    )
    scored = C.score_chained(*models, payers_of(db), coming_year(db))
    digits = {"predicted_income": 3, "predicted_transactions": 5, "predicted_tax": 3}
    return scored.withColumns({c: F.round(c, n) for c, n in digits.items()})


@question("score_chained_shape", SHAPE_SQL, views="monthly_tax taxpayer")
def score_chained_shape(db: Warehouse) -> DataFrame:
    # All inputs and the economy; tax is not cut at zero in the chained forecast.
    return shape(C.score_chained(*chained_models(db), payers_of(db), coming_year(db)), "predicted_income")


@question("predict_freshness", """
    select (select max(yr) from monthly_tax) as last_real_year,
      (select max(yr) from predict) as last_predicted_year,
      (select max(yr) from predict) <= (select max(yr) from monthly_tax) as stale""",
    views="monthly_tax predict")
def predict_freshness(db: Warehouse) -> DataFrame:
    return metadata.freshness(db.spark, db.facts_folder, db.predicted_folder)


@question("q_predict_inn", f"with {LINES_SQL} select * from ({OWN_YEAR_SQL}) where inn = '{ONE_INN}'",
          views="monthly_tax taxpayer")
def q_predict_inn(db: Warehouse) -> DataFrame:
    return C.score_payers(forecast_model(db), db.stored_facts, db.stored_payers, ONE_INN)


@question("q_predict_inn_full_shape", f"""
    select tax_type, cast((select max(yr) from monthly_tax o where o.taxpayer_id = p.taxpayer_id) + 1 as int) as yr,
      count(*) as n_months, cast(1 as bigint) as n_payers
    from ({PAYERS_BY_TYPE_SQL}) p, (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) months(mon)
    where inn = '{ONE_INN}' group by all""", views="monthly_tax taxpayer")
def q_predict_inn_full_shape(db: Warehouse) -> DataFrame:
    scored = C.score_payers(full_model(db), db.stored_facts, db.stored_payers, ONE_INN)
    return scored.where("predicted_income >= 0").groupBy("tax_type", "yr").agg(
        F.count(F.lit(1)).alias("n_months"), F.count_distinct("taxpayer_id").alias("n_payers")
    )


@question("q_predict_all", f"with {LINES_SQL} {OWN_YEAR_SQL}", views="monthly_tax taxpayer")
def q_predict_all(db: Warehouse) -> DataFrame:
    return C.score_payers(forecast_model(db), db.stored_facts, db.taxpayer)


@question("q_predict_all_shape", f"""
    select t.inn, m.tax_type, max(m.yr) over (partition by m.taxpayer_id) + 1 as prediction_year,
      cast(12 as bigint) as n_months
    from monthly_tax m join taxpayer t on m.taxpayer_id = t.taxpayer_id
    qualify row_number() over (partition by m.taxpayer_id, m.tax_type order by m.yr) = 1""",
    views="monthly_tax taxpayer")
def q_predict_all_shape(db: Warehouse) -> DataFrame:
    scored = C.score_payers(full_model(db), db.stored_facts, db.taxpayer)
    return scored.groupBy("inn", "tax_type", F.col("yr").alias("prediction_year")).agg(
        F.count(F.lit(1)).alias("n_months")
    )


@question("q_refresh_forecast", f"""
    with {LINES_SQL} select taxpayer_id, full_name, inn, yr, mon, predicted_income as income,
      predicted_transactions as transactions, predicted_tax as tax, tax_type, taxpayer_type, activity_type,
      registration_district, has_employees, employees_count from ({GRID_SQL})""", views="monthly_tax taxpayer")
def q_refresh_forecast(db: Warehouse) -> DataFrame:
    return refreshed(db, forecast_model(db))


def refreshed(db: Warehouse, model: PipelineModel) -> DataFrame:
    path = shared_folder(db.spark, "predict")
    C.refresh_forecast(model, db.stored_facts, db.taxpayer, path)
    # The second call finds the forecast current and leaves it alone.
    return C.refresh_forecast(model, db.stored_facts, db.taxpayer, path)


@question("q_refresh_forecast_shape", f"""
    select yr, tax_type, count(*) as n_rows, count(distinct taxpayer_id) as n_payers
    from (select cast(2001 as int) as yr, p.* from ({PAYERS_BY_TYPE_SQL}) p,
      (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) months(mon))
    group by yr, tax_type""", views="monthly_tax taxpayer")
def q_refresh_forecast_shape(db: Warehouse) -> DataFrame:
    per_payer = refreshed(db, full_model(db)).groupBy("yr", "tax_type", "taxpayer_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_payer.groupBy("yr", "tax_type").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_payers")
    )


@question("forecast_reconciles", """
    select count(*) as n_payers, cast(0 as bigint) as n_off
    from (select distinct taxpayer_id from monthly_tax)""", views="monthly_tax")
def forecast_reconciles(db: Warehouse) -> DataFrame:
    # Yearly sums, and the months summed in the other order, must agree to the cent.
    monthly = score_grid(db).withColumns({
        "predicted_income": F.col("predicted_income").cast("decimal(18,2)"),
        "predicted_tax": F.col("predicted_tax").cast("decimal(18,2)"),
    })
    named = {f"predicted_{m}": m for m in MEASURES}
    by_year = payer_year_summary(monthly.withColumnsRenamed(named))
    by_type = monthly.groupBy("taxpayer_id", "tax_type").agg(
        *[F.sum(f"predicted_{m}").alias(m) for m in MEASURES]
    ).groupBy("taxpayer_id").agg(*[F.sum(m).alias(m) for m in MEASURES])
    off = F.lit(False)
    for m in MEASURES:
        off = off | (F.col(m) != F.col(f"total_predicted_{m}"))
    return by_year.join(by_type, "taxpayer_id").agg(
        F.count(F.lit(1)).alias("n_payers"), F.count_if(off).alias("n_off")
    )

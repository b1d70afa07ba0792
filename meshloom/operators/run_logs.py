"""Logs of training runs as tables: logs(log_id, text) -> a row per experiment, round or result line.

Everything is a projection and an explode per log; what must be found in a text is stated as patterns below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators.reports import concatenated

# What runs print, and the data sets and methods that are reported on.
SECTION = r"(?s)Running experiment \d+/\d+:.*?(?=Running experiment|\z)"
RULED_SECTION = r"(?s)-{80}\nRunning experiment \d+/\d+:.*?(?=-{80}|\z)"
BARE_SECTION = r"(?s)Dataset: [a-zA-Z0-9-]+, Trainers: \d+, Distribution: [a-zA-Z0-9-]+, IID Beta: [\d.]+.*?(?=Dataset:|\z)"
RULE = r"-{80}\nRunning experiment \d+/\d+:"
INFORMAL_SECTION = r"(?s)Running ([A-Za-z0-9+_]+) \.\.\..*?(?=Running|\z)"
PROCESS_END = "The whole process has ended"
TRAINERS, BETA = r"Trainers: (\d+)", r"IID Beta: ([\d.]+)"
METHOD, CHANGED_METHOD = r"method': '([A-Za-z0-9+_]+)'", r"Changing method to ([A-Za-z0-9+_]+)"
ROUND_ACCURACY = r"Round (\d+): Global Test Accuracy = ([\d.]+)"
TRAIN_TIME = r"//train_time: ([\d.]+) ms//end"
THEORETICAL = {"pretrain": r"//Log Theoretical Pretrain Comm Cost: ([\d.]+) MB //end", "train": r"//Log Theoretical Train Comm Cost: ([\d.]+) MB //end"}
ACTUAL = {"pretrain": r"//Log Total Actual Pretrain Comm Cost: ([\d.]+) MB //end", "train": r"//Log Total Actual Train Comm Cost: ([\d.]+) MB //end"}
NODE_DATASETS = ("cora", "citeseer", "pubmed", "ogbn-arxiv")
GRAPH_DATASETS = ("IMDB-BINARY", "IMDB-MULTI", "MUTAG", "BZR", "COX2")
GRAPH_METHODS = ("FedAvg", "GCFL", "GCFL+", "GCFL+dWs")
START_LINE = r"^Running experiment with: Dataset=([^,]+),\s*Number of Trainers=(\d+),\s*Distribution Type=([^,]+),\s*IID Beta=([0-9.]+),\s*Number of Hops=(\d+),\s*Batch Size=([^,]+)"
PRETRAIN_END = "Pretrain end time recorded and duration set to gauge."
RESULT_LINE = r"(?s)CSV FORMAT RESULT:.*?DS,IID,BS,TotalTime\[s\],PureTrainingTime\[s\],CommTime\[s\],FinalAcc\[%\],CommCost\[MB\],PeakMem\[MB\],AvgRoundTime\[s\],ModelSize\[MB\],TotalParams\n(.*?)\n"
RESULT_FIELDS = ("total_time", "training_time", "communication_time", "final_accuracy", "communication_cost", "peak_memory", "avg_round_time", "model_size", "total_params")
FRAMEWORK_LINE = r"DS,IID,BS,Time\[s\],FinalAcc\[%\],CompTime\[s\],CommCost\[MB\],PeakMem\[MB\],AvgRoundTime\[s\],ModelSize\[MB\],TotalParams\n((?:[^,\n]+,){10}[^,\n]+)"
FRAMEWORK_FIELDS = ("total_time", "final_accuracy", "computation_time", "communication_cost", "peak_memory", "avg_round_time", "model_size", "total_params")
DEFAULT_TRAINERS, DEFAULT_METHOD, DEFAULT_COUNTRY = 10, "FedAvg", "US"


def first_of(text: str, *patterns: str) -> Column:
    """What group 1 of the first pattern that matches finds first; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def last_of(text: str, *patterns: str, group: int = 1) -> Column:
    """The same for what is found last."""
    return F.coalesce(*[F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(group)), F.lit(-1)) for p in patterns])


def number(found: Column) -> Column:
    """A found text as a number; null if it is none, such as 1.2.3."""
    return found.try_cast("double")


def _first_sections(text: str, *patterns: str) -> Column:
    """All that the first pattern with any match finds."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]
    out = found[-1]
    for some in reversed(found[:-1]):
        out = F.when(F.size(some) > 0, some).otherwise(out)
    return out


def _costs(rows: DataFrame, keep: list[str], zero_actual: bool = False) -> DataFrame:
    """rows(section, accuracy, ...) with train_ms and costs in MB; rows that have none of them at all are left out.

    Theoretical costs are 0 where they are missing, actual ones null, and so is their total then.
    """
    text = "section"
    rows = rows.withColumn("train_ms", number(first_of(text, TRAIN_TIME)))
    for phase in ("pretrain", "train"):
        rows = rows.withColumn(f"theoretical_{phase}_mb", number(last_of(text, THEORETICAL[phase]))).withColumn(f"actual_{phase}_mb", number(first_of(text, ACTUAL[phase])))
    some = F.coalesce("accuracy", "train_ms", "theoretical_pretrain_mb", "theoretical_train_mb", "actual_pretrain_mb", "actual_train_mb").isNotNull()
    zero = ["theoretical_pretrain_mb", "theoretical_train_mb"] + ["actual_pretrain_mb", "actual_train_mb"] * zero_actual
    rows = rows.where(some).na.fill(0.0, zero)
    for kind in ("theoretical", "actual"):
        rows = rows.withColumn(f"{kind}_total_mb", F.col(f"{kind}_pretrain_mb") + F.col(f"{kind}_train_mb"))
    return rows.select("log_id", *keep, "accuracy", "train_ms", *[f"{k}_{p}_mb" for k in ("theoretical", "actual") for p in ("pretrain", "train", "total")])


def node_experiments(logs: DataFrame) -> DataFrame:
    """Node classification: sections by three patterns in fallback order; those of other data sets are left out."""
    rows = logs.select("log_id", F.posexplode(_first_sections("text", SECTION, RULED_SECTION, BARE_SECTION)).alias("pos", "section"))
    rows = rows.withColumns({
        "dataset": first_of("section", r"Dataset: ([a-zA-Z0-9-]+)"), "iid_beta": number(first_of("section", BETA)),
        "trainers": F.coalesce(first_of("section", TRAINERS).cast("int"), F.lit(DEFAULT_TRAINERS)),
        "algorithm": F.coalesce(first_of("section", METHOD, CHANGED_METHOD), F.lit(DEFAULT_METHOD)),
        "accuracy": number(F.coalesce(first_of("section", r"Average test accuracy, ([\d.]+)"), last_of("section", ROUND_ACCURACY, group=2))),
    })
    rows = rows.where(F.col("dataset").isin(*NODE_DATASETS) & F.col("iid_beta").isNotNull())
    return _costs(rows, ["pos", "algorithm", "dataset", "trainers", "iid_beta"])


def graph_experiments(logs: DataFrame) -> DataFrame:
    """Graph classification: formal sections, and informal runs that name their method in their first line."""
    formal = logs.select("log_id", F.posexplode(F.slice(F.split("text", RULE), 2, 1 << 30)).alias("pos", "section"))
    formal = formal.select("*", F.lit("formal").alias("kind"), first_of("section", r"Algorithm: ([A-Za-z0-9+_]+)").alias("algorithm"), first_of("section", r"Dataset: ([A-Z0-9-]+)").alias("dataset"))
    informal = logs.select("log_id", F.posexplode(F.regexp_extract_all("text", F.lit(INFORMAL_SECTION), F.lit(0))).alias("pos", "section"))
    dataset = first_of("section", r"Dataset: ([A-Z0-9-]+)", r"dataset_trainer_name: \d+-([A-Z0-9-]+)")
    informal = informal.select("*", F.lit("informal").alias("kind"), first_of("section", r"Running ([A-Za-z0-9+_]+) \.\.\.").alias("algorithm"), dataset.alias("dataset"))
    rows = formal.unionByName(informal).where(F.col("dataset").isin(*GRAPH_DATASETS) & F.col("algorithm").isin(*GRAPH_METHODS))
    rows = rows.withColumn("trainers", F.coalesce(first_of("section", TRAINERS).cast("int"), F.lit(DEFAULT_TRAINERS)))
    return _costs(rows.withColumn("accuracy", number(first_of("section", r"Average test accuracy: ([\d.]+)"))), ["kind", "pos", "algorithm", "dataset", "trainers"])


def link_experiments(logs: DataFrame) -> DataFrame:
    """Link prediction: last AUC and hit rate, mean train time in ms; sections by rule, else by the process's end.

    Embedding traffic is not added to the costs here, as sizes of the embeddings are not in a log; see cost.py.
    """
    ruled, ended = F.slice(F.split("text", RULE), 2, 1 << 30), F.split("text", PROCESS_END)
    sections = F.when(F.size(ruled) > 0, ruled).otherwise(F.slice(ended, 1, F.size(ended) - 1))
    rows = logs.select("log_id", F.posexplode(sections).alias("pos", "section"))
    times = F.regexp_extract_all("section", F.lit(r"train time ([\d.]+)"), F.lit(1))
    mean = F.aggregate(times, F.lit(0.0), lambda s, t: s + t.try_cast("double") * 1000) / F.nullif(F.size(times), F.lit(0))
    listed = F.trim(F.regexp_replace(first_of("section", r"Countries: ([^,\n]+(?:, [^,\n]+)*)", r"country_codes: \[(.*?)\]"), "['\"]", ""))
    rows = rows.withColumns({
        "algorithm": F.coalesce(F.trim(first_of("section", r"Method: ([^,\n]+)", r"Running method: ([^,\n]+)")), F.concat(F.lit("Method_"), F.col("pos") + 1)),
        "dataset": F.coalesce(F.nullif(listed, F.lit("")), first_of("section", r"data_([A-Z]{2})\.txt"), F.lit(DEFAULT_COUNTRY)),
        "accuracy": number(last_of("section", r"Test AUC: ([\d.]+)", r"Predict Day \d+ average auc score: ([\d.]+)")),
        "hit_rate": number(last_of("section", r"Test Hit Rate at \d+: ([\d.]+)", r"hit rate: ([\d.]+)")), "mean_ms": mean,
    })
    out = _costs(rows, ["pos", "algorithm", "dataset", "hit_rate", "mean_ms"], zero_actual=True)
    return out.withColumn("train_ms", F.coalesce("train_ms", "mean_ms")).drop("mean_ms").withColumnRenamed("accuracy", "auc")


def round_accuracies(logs: DataFrame) -> DataFrame:
    """(log_id, dataset, algorithm, round, accuracy) of every round of every experiment."""
    rows = logs.select("log_id", F.explode(F.regexp_extract_all("text", F.lit(SECTION), F.lit(0))).alias("section"))
    rows = rows.withColumn("dataset", first_of("section", r"Dataset: ([a-zA-Z0-9_-]+)")).where("dataset is not null")
    rows = rows.withColumn("algorithm", F.coalesce(first_of("section", METHOD, CHANGED_METHOD), F.lit(DEFAULT_METHOD)))
    r, a = (F.regexp_extract_all("section", F.lit(ROUND_ACCURACY), F.lit(g)) for g in (1, 2))
    out = rows.select("log_id", "dataset", "algorithm", F.explode(F.arrays_zip(r.alias("r"), a.alias("a"))).alias("z"))
    return out.select("log_id", "dataset", "algorithm", F.col("z.r").cast("int").alias("round"), number(F.col("z.a")).alias("accuracy"))


def line_metrics(lines: DataFrame) -> DataFrame:
    """lines(log_id, line_no, line) -> (log_id, experiment, line_no, metric, value): each line's numbers, named by phase.

    An experiment begins with its start line, in its pretrain phase; the pretrain end line begins its train phase. Lines
    before the first start line belong to experiment 0. A log is one window: logs are many, and each is of bounded size.
    """
    upto = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("line").rlike(START_LINE)
    mark = F.when(starts | F.col("line").rlike(r"pretrain_time: \d+\.\d+"), "Pretrain").when(F.col("line").contains(PRETRAIN_END), "Train")
    lines = lines.withColumn("experiment", F.sum(starts.cast("int")).over(upto)).withColumn("phase", F.last(mark, ignorenulls=True).over(upto))
    found = lambda p, g=1: F.nullif(F.regexp_extract("line", p, g), F.lit(""))
    value = r": (\d+\.\d+)"
    pairs = [
        (F.lit("Pretrain Time"), found("pretrain_time" + value)), (F.lit("Train Time"), found("(?<!pre)train_time" + value)),
        (F.concat("phase", F.lit(" Max Trainer Memory"), found(r"Log Max memory for Large(\d+)" + value)), found(r"Log Max memory for Large(\d+)" + value, 2)),
        (F.concat("phase", F.lit(" Max Server Memory")), found("Log Max memory for Server" + value)),
        (F.concat("phase", F.lit(" Network "), found(r"Log ([^,]+) network" + value)), found(r"Log ([^,]+) network" + value, 2)),
        (F.lit("Average Test AUC"), found(r"average auc score: (\d+\.\d+) hit rate: (\d+\.\d+)")), (F.lit("Hit Rate"), found(r"average auc score: (\d+\.\d+) hit rate: (\d+\.\d+)", 2)),
        (F.lit("Number of Trainers"), found(START_LINE, 2)), (F.lit("IID Beta"), found(START_LINE, 4)), (F.lit("Number of Hops"), found(START_LINE, 5)), (F.lit("Batch Size"), found(START_LINE, 6)),
    ]
    structs = F.array(*[F.struct(m.alias("metric"), v.try_cast("double").alias("value")) for m, v in pairs])
    out = lines.select("log_id", "experiment", "line_no", F.explode(F.filter(structs, lambda s: s["metric"].isNotNull() & s["value"].isNotNull())).alias("s"))
    return out.select("log_id", "experiment", "line_no", "s.metric", "s.value")


def experiments_wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row per experiment with a column per named metric: its last value."""
    return metrics.where("experiment > 0").groupBy("log_id", "experiment").pivot("metric", names).agg(F.max_by("value", "line_no"))


def _result_rows(logs: DataFrame, pattern: str, fields: tuple[str, ...]) -> DataFrame:
    """Result lines as columns: dataset, beta, batch size and the fields; a line with a field that is no number is left out."""
    rows = logs.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("pos", "line"))
    rows = rows.withColumn("parts", F.transform(F.split("line", ","), lambda field: F.trim(field))).where(F.size("parts") >= 3 + len(fields))
    numbers = [F.col("parts")[3 + i].try_cast("double").alias(f) for i, f in enumerate(fields)]
    out = rows.select("log_id", "text", "pos", F.col("parts")[0].alias("dataset"), F.col("parts")[1].try_cast("double").alias("iid_beta"), F.col("parts")[2].try_cast("int").alias("batch_size"), *numbers)
    return out.dropna(subset=["iid_beta", "batch_size", *fields]).withColumn("total_params", F.col("total_params").cast("long"))


def scalability_rows(logs: DataFrame, trainers: int | None = None) -> DataFrame:
    """Result lines with their number of trainers: the given one, else that which the log names at the same place."""
    named = F.try_element_at(F.regexp_extract_all("text", F.lit(TRAINERS), F.lit(1)), F.col("pos") + 1).cast("int")
    out = _result_rows(logs, RESULT_LINE, RESULT_FIELDS)
    return out.withColumn("trainers", F.lit(trainers) if trainers else F.coalesce(named, F.lit(DEFAULT_TRAINERS))).drop("text")


def framework_rows(logs: dict[str, DataFrame]) -> DataFrame:
    """One table of the result lines of several frameworks' logs, by name."""
    return concatenated([_result_rows(df, FRAMEWORK_LINE, FRAMEWORK_FIELDS).drop("text").withColumn("framework", F.lit(name)) for name, df in logs.items()])

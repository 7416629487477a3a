"""Whole workflows: cohort import, split, selection, evaluation and measurement.

Each joins the operators into the order that keeps test data out of decisions:
components before exclusion, thresholds from validation scores alone, metrics
on test scores last. Tables stay DataFrames; small records are JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.functions import CATEGORY_LABELS, mapped_label
from corvida.operators import binding, contracts, identity, lineage, metrics, resampling, split, threshold
from corvida.session import Stage
from corvida.sources import files, sinks, tables
from corvida.sources.store import read_bytes

SCHEMA_VERSION = 1


def import_cohort(spark: SparkSession, source: str, pixel_hash: Callable[[Column], Column] | None = None, expected: DataFrame | None = None) -> dict[str, DataFrame]:
    """``included``, ``excluded``, ``components``, ``counts`` and ``files`` of a folder of case and image files.

    Cases are linked by equal image bytes and, if ``pixel_hash`` makes a digest
    of an image's content, by equal pixels; all cases take part, labelled or
    not. ``expected`` is a table of name, sha256 and size that the folder must
    equal.
    """
    stage = Stage(spark, "cohort")
    files.refuse_links(spark, source)
    found = stage.write(tables.inventory(spark, source))
    if expected is not None:
        contracts.require(contracts.difference(found.select("name", "sha256", "size"), expected), "source files differ from the expected ones")
    cases = stage.write(tables.case_files(spark, source))
    images = found.where("view IS NOT NULL")
    marks = cases.select("case_id", F.explode("views").alias("view"))
    pairs = images.select(F.struct("case_id", "view").alias("k")), marks.select(F.struct("case_id", "view").alias("k"))
    contracts.require(contracts.unmatched(*pairs, "k"), "marks and image files differ")
    keys = ["sha256"]
    if pixel_hash is not None:
        content = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(source)
        pixels = content.select(F.substring_index("path", "/", -1).alias("name"), pixel_hash(F.col("content")).alias("pixel_sha256"))
        images, keys = images.join(pixels, "name"), ["sha256", "pixel_sha256"]
    rows = images.join(cases.select("case_id", "category"), "case_id")
    linked = identity.link_components(stage.write(rows), "case_id", keys)
    rows = stage.write(rows.join(linked, "case_id").withColumn("label", mapped_label(F.col("category"))))
    included, excluded = identity.exclude_missing(rows)
    for key in keys:
        contracts.require(identity.conflicting(included, key, "label"), f"images of one {key} with different labels")
    parts = linked.groupBy("component").agg(F.array_sort(F.collect_list("case_id")).alias("cases"))
    return {"included": included, "excluded": excluded, "components": parts, "counts": identity.cohort_counts(rows), "files": found}


def import_classes(spark: SparkSession, root: str, groups: str | None = None, independent: bool = False) -> DataFrame:
    """``sample_id, group, content_hash, label, size`` of two class folders, which hold no links.

    Groups come from a CSV that names every file and no other, or the caller
    says that files are independent: one of the two, so that it is no oversight.
    """
    if (groups is None) != independent:
        raise ValueError("give groups or say that files are independent")
    files.refuse_links(spark, root)
    rows = Stage(spark, "classes").write(tables.class_directories(spark, root).select(F.col("source").alias("sample_id"), F.col("sha256").alias("content_hash"), "label", "size"))
    if groups is None:
        return rows.select("sample_id", F.col("sample_id").alias("group"), "content_hash", "label", "size")
    named = tables.group_csv(spark, groups).withColumnRenamed("path", "sample_id")
    contracts.require(contracts.unsafe_paths(named, "sample_id"), "unsafe paths")
    contracts.require(contracts.unmatched(rows, named, "sample_id"), "files and named groups differ")
    return rows.join(named, "sample_id").select("sample_id", "group", "content_hash", "label", "size")


COHORT_KIND, CLASS_NAMES = "case_cohort", ("low", "high")
_IDENTITY = ["name", "case_id", "view", "sha256", "size", "category", "component", "label"]


def cohort_record(cohort: dict[str, DataFrame]) -> dict:
    """What a cohort is: its kind, classes, the label of each category, and fingerprints of what is in and out."""
    return {
        "schema_version": SCHEMA_VERSION,
        "kind": COHORT_KIND,
        "class_names": list(CLASS_NAMES),
        "categories": dict(CATEGORY_LABELS),
        "included": identity.fingerprint(cohort["included"], _IDENTITY).first().fingerprint,
        "excluded": identity.fingerprint(cohort["excluded"], [c for c in _IDENTITY if c != "label"]).first().fingerprint,
    }


def check_cohort(cohort: dict[str, DataFrame], record: dict) -> None:
    """Raise ValueError with all that a cohort's record doesn't say of its tables."""
    want = cohort_record(cohort)
    if wrong := sorted(k for k in want.keys() | record.keys() if record.get(k) != want.get(k)):
        raise ValueError(f"the cohort's record differs in {wrong}")


def load_cohort(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A published cohort, after comparing its tables with its record."""
    cohort = {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("included", "excluded", "components", "counts")}
    check_cohort(cohort, json.loads(spark.read.parquet(f"{path.rstrip('/')}/record").first().record))
    return cohort


def cohort_samples(cohort: dict[str, DataFrame]) -> DataFrame:
    """``sample_id, group, content_hash, label, size`` of a cohort's labelled images, to be split."""
    return cohort["included"].select(F.col("name").alias("sample_id"), F.concat(F.lit("case-"), F.col("component").cast("string")).alias("group"), F.col("sha256").alias("content_hash"), "label", "size")


def check_cohort_rows(rows: DataFrame, cohort: dict[str, DataFrame], record: dict | None = None) -> None:
    """Rows of a split must be those of a cohort, no more and no fewer, with its groups, labels, digests and sizes."""
    if record is not None:
        check_cohort(cohort, record)
    named = [F.col("sample_id").alias("path"), F.trim(F.col("group").cast("string")).alias("group"), "label", F.col("content_hash").alias("sha256"), "size"]
    held = cohort_samples(cohort).select(*named).join(cohort["included"].select(F.col("name").alias("path"), "category"), "path")
    contracts.require(binding.cohort_faults(held, rows.select(*named)), "rows differ from the cohort")


def create_split(rows: DataFrame, train: float = 0.7, validation: float = 0.15, seed: int = 0, method: str = "runs", cohort: dict[str, DataFrame] | None = None, record: dict | None = None) -> DataFrame:
    """``sample_id, group, content_hash, label, split`` of labelled rows with these columns but the last.

    Rows of one group or one content share a split; the result fulfils
    ``check_manifest``. Components are dealt by greedy allocation, equal ones
    together (``runs``) or one by one in a task (``greedy``), or by hashed rank.
    With a ``cohort`` the rows, which then have ``size``, must be its own.
    """
    if method not in ("runs", "greedy", "rank"):
        raise ValueError(f"unknown method {method}")
    if cohort is not None:
        check_cohort_rows(rows, cohort, record)
    held = Stage(rows.sparkSession, "split").write(rows.select("sample_id", F.trim(F.col("group").cast("string")).alias("group"), "content_hash", "label"))
    contracts.require(contracts.repeated(held, "sample_id"), "repeated sample_id")
    contracts.require(identity.conflicting(held, "content_hash", "label"), "content with conflicting labels")
    linked = held.join(identity.link_components(held, "sample_id", ["group", "content_hash"]), "sample_id")
    few = linked.groupBy("label").agg(F.count_distinct("component").alias("n")).where("n < 3")
    contracts.require(few, "each class needs three components")
    if method == "rank":
        made = split.rank_split(linked, train, validation)
    else:
        made = (split.greedy_run_split if method == "runs" else split.greedy_split)(linked, train, validation, seed)
    out = Stage(rows.sparkSession, "split").write(linked.join(made, "component").select(*held.columns, "split"))
    contracts.check_manifest(out)
    return out


def split_paths(manifest: DataFrame, class_names: tuple[str, str]) -> DataFrame:
    """``manifest`` with ``path``: each file below the folders of its split and its class, under its own name without the class folder."""
    name = F.when(F.substring_index("sample_id", "/", 1).isin(*class_names), F.expr("substring(sample_id, locate('/', sample_id) + 1)")).otherwise(F.col("sample_id"))
    return manifest.withColumn("path", F.concat_ws("/", "split", F.get(F.array(*map(F.lit, class_names)), F.col("label").cast("int")), name))


def publish_split_files(manifest: DataFrame, sizes: DataFrame, source: str, target: str, class_names: tuple[str, str]) -> None:
    """The files of a split, copied to ``split/class/name`` in one new folder with the table ``manifest``, all or none.

    ``sizes(sample_id, size)`` are those of the import. What was written is
    hashed again; a file that changed since the import or that collides with
    another stops the whole.
    """
    contracts.check_manifest(manifest)
    rows = Stage(manifest.sparkSession, "published").write(split_paths(manifest, class_names).join(sizes.select("sample_id", "size"), "sample_id", "left"))
    contracts.require(binding.path_faults(rows, class_names), "paths that aren't those of their split and class")
    files.publish_files(rows.select(F.col("sample_id").alias("source"), "path", F.col("content_hash").alias("sha256"), "size"), source, target, {"manifest": rows})


def publish_cohort_files(cohort: dict[str, DataFrame], source: str, target: str) -> None:
    """The labelled images of a cohort copied to ``data/class/name``, with its tables, its record and ``groups``, all or none; the whole source is read again first."""
    named = F.concat_ws("/", F.lit("data"), F.get(F.array(*map(F.lit, CLASS_NAMES)), F.col("label")), "name")
    now = tables.inventory(cohort["included"].sparkSession, source).select("name", "sha256", "size")
    contracts.require(contracts.difference(cohort["files"].select(*now.columns), now), "source files changed during the import")
    groups = cohort["included"].select(named.alias("path"), F.concat(F.lit("case-"), F.col("component").cast("string")).alias("group"))
    files.publish_files(cohort["included"].select(F.col("name").alias("source"), named.alias("path"), "sha256", "size"), source, target, _cohort_tables(cohort) | {"groups": groups})


def manifest_fingerprint(manifest: DataFrame) -> str:
    return identity.fingerprint(manifest, ["sample_id", "group", "content_hash", "label", "split"]).first().fingerprint


def load_split(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """A published split, after all its rules and, if given, its fingerprint."""
    rows = spark.read.parquet(path)
    contracts.check_manifest(rows)
    if fingerprint is not None and manifest_fingerprint(rows) != contracts.check_digest(fingerprint):
        raise ValueError(f"{path} is another split")
    return rows


def save_sidecar(path: str, model: bytes, manifest: DataFrame, seed: int, class_names: tuple[str, str] = ("0", "1"), architecture: str = "logistic", inputs: tuple[int, ...] = (1,), **extra) -> dict:
    """What a model was made from, written once beside it.

    The digests it was fitted and chosen on go to the table ``path.history``, as
    they grow with the data; the record has their fingerprint.
    """
    seen = trained_history(manifest, lineage.digest(model))
    record = {
        "schema_version": SCHEMA_VERSION,
        "model_sha256": lineage.digest(model),
        "architecture": architecture,
        "inputs": list(inputs),
        "class_names": list(class_names),
        "seed": seed,
        "source": identity.fingerprint(manifest, ["sample_id", "content_hash"]).first().fingerprint,
        "manifest": manifest_fingerprint(manifest),
        "trained": identity.fingerprint(seen, ["content_hash"]).first().fingerprint,
        "training": extra,
    }
    _check_sidecar(record, path)
    sinks.publish(seen, f"{path}.history")
    lineage.write_once(path, record)
    return record


def _check_sidecar(record: dict, path: str) -> None:
    names, inputs = record.get("class_names", ()), record.get("inputs", ())
    if record.get("schema_version") != SCHEMA_VERSION or len(names) != 2 or len(set(names)) != 2 or not record.get("architecture"):
        raise ValueError(f"{path}: unknown version, architecture or classes")
    if not inputs or any(isinstance(x, bool) or not isinstance(x, int) or x < 1 for x in inputs):
        raise ValueError(f"{path}: input sizes must be positive whole numbers")
    for key in ("model_sha256", "source", "manifest", "trained"):
        contracts.check_digest(record.get(key))


def load_sidecar(path: str, model: bytes | None = None, manifest: DataFrame | None = None) -> dict:
    record = json.loads(read_bytes(path))
    _check_sidecar(record, path)
    if model is not None and lineage.digest(model) != record["model_sha256"]:
        raise ValueError(f"{path} describes another model")
    if manifest is not None and manifest_fingerprint(manifest) != record["manifest"]:
        raise ValueError(f"{path} was made from another split")
    return record


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """``model, content_hash`` of the model beside a sidecar, after comparing them with its fingerprint."""
    record, rows = load_sidecar(path), spark.read.parquet(f"{path}.history")
    contracts.require(rows.where(F.col("model") != record["model_sha256"]), f"{path}: another model's history")
    if identity.fingerprint(rows, ["content_hash"]).first().fingerprint != record["trained"]:
        raise ValueError(f"{path}: the history has changed")
    return rows


def judged(manifest: DataFrame, scores: DataFrame, part: str) -> DataFrame:
    """``model, sample_id, y, p`` of one part of the split; every model must score each of its samples once."""
    contracts.require(contracts.bad_scores(scores), "invalid scores")
    want = manifest.where(F.col("split") == part).select("sample_id", F.col("label").alias("y"))
    rows = scores.join(want, "sample_id").select("model", "sample_id", "y", "p")
    n = want.count()
    contracts.require(rows.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("d")).where(f"n != {n} OR d != {n}"), f"models that don't score every {part} sample once")
    return rows


def select_thresholds(manifest: DataFrame, scores: DataFrame) -> DataFrame:
    """``model, threshold, tp, tn, objective, balanced_accuracy`` from validation samples; the ensemble is one more model."""
    return threshold.choose_threshold(metrics.with_ensemble(judged(manifest, scores, "validation")))


def selection_record(manifest: DataFrame, scores: DataFrame) -> dict:
    """A JSON record of the decisions and of what they came from."""
    chosen = {r.model: {"threshold": r.threshold, "tp": r.tp, "tn": r.tn} for r in select_thresholds(manifest, scores).collect()}
    evidence = identity.fingerprint(judged(manifest, scores, "validation"), ["model", "sample_id", "y", "p"]).first()
    return {"schema_version": SCHEMA_VERSION, "split": "validation", "objective": "balanced_accuracy", "manifest": manifest_fingerprint(manifest), "evidence": evidence.fingerprint, "samples": evidence.n_rows, "decisions": chosen}


def load_selection(path: str, manifest: DataFrame, scores: DataFrame) -> dict:
    """A stored record, after making it anew from its evidence and comparing the two."""
    stored = json.loads(read_bytes(path))
    if lineage.canonical(stored) != lineage.canonical(selection_record(manifest, scores)):
        raise ValueError(f"{path} doesn't follow from its evidence")
    return stored


def trained_history(manifest: DataFrame, model: str) -> DataFrame:
    """``model, content_hash``: what a model was fitted and chosen on, to be stored beside it as rows that can be joined."""
    return manifest.where("split != 'test'").select(F.lit(model).alias("model"), "content_hash").distinct()


def evaluate(manifest: DataFrame, scores: DataFrame, fixed: float | None = None, selection: dict | None = None, history: DataFrame | None = None, models: DataFrame | None = None, class_names: tuple[str, str] = ("0", "1"), strict: bool = True) -> DataFrame:
    """Test metrics, one row per model, at one fixed threshold or at those of a selection.

    ``history`` is ``trained_history`` of the models, from whatever split they
    were made with; a model that saw a test digest there is refused. ``models``
    are their records, ``model, model_sha256, class_names, manifest``: all have
    these classes in this order and this split, and no two are one model.
    """
    if (fixed is None) == (selection is None):
        raise ValueError("give a fixed threshold or a selection")
    if strict:
        contracts.check_manifest(manifest)
    contracts.require(contracts.leaked(manifest.where("split != 'test'"), manifest.where("split = 'test'"), "content_hash"), "trained on test content")
    if history is not None:
        contracts.require(contracts.unmatched(history, scores, "model").where("NOT left_only"), "models without a history")
        contracts.require(contracts.history_leaks(history.join(scores.select("model").distinct(), "model", "left_semi"), manifest), "models that saw test content")
    if models is not None:
        contracts.require(binding.model_faults(models, class_names, manifest_fingerprint(manifest)), "models that can't be judged together")
        contracts.require(contracts.unmatched(models, scores, "model"), "models and scores differ")
    rows = Stage(manifest.sparkSession, "evaluate").write(metrics.with_ensemble(judged(manifest, scores, "test")))
    if selection is not None:
        if selection["manifest"] != manifest_fingerprint(manifest):
            raise ValueError("the selection belongs to another split")
        cuts = [(m, contracts.check_threshold(d["threshold"])) for m, d in selection["decisions"].items()]
        cuts = manifest.sparkSession.createDataFrame(cuts, "model string, threshold double")
        if strict:
            contracts.require(contracts.unmatched(rows, cuts, "model"), "models and decisions differ")
    else:
        cuts = rows.select("model").distinct().withColumn("threshold", F.lit(contracts.check_threshold(fixed)))
    return metrics.binary_metrics(rows, cuts)


def check_runs(manifest: DataFrame, reports: DataFrame | None = None, fits: DataFrame | None = None, reported: DataFrame | None = None, histories: DataFrame | None = None) -> None:
    """Raise ValueError where runs don't follow from one another.

    ``reports`` and ``fits`` have a row for each seed (``binding.run_faults``)
    and name this split; ``reported`` samples are those of its test part;
    ``histories`` have finite losses for the epochs 1, 2, …
    """
    if (reports is None) != (fits is None):
        raise ValueError("give reports and fits together")
    if reports is not None:
        contracts.require(binding.run_faults(reports, fits), "reports that don't follow from their fits")
        contracts.require(reports.where(~F.coalesce(F.col("manifest_sha256") == manifest_fingerprint(manifest), F.lit(False))).select("seed"), "reports of another split")
    if reported is not None:
        contracts.require(binding.sample_faults(reported, manifest), "reported samples differ from the test part")
    if histories is not None:
        contracts.require(binding.history_faults(histories), "histories with gaps")


def measure(manifest: DataFrame, scores: DataFrame, repetitions: int = 2000, seed: int = 1729, kind: str = "splitting", strict: bool = True, **runs: DataFrame) -> dict[str, DataFrame]:
    """Repeated-seed measurement; ``scores(seed, sample_id, p)`` has a run for each of two or more seeds.

    ``per_seed`` compares the selected threshold with 0.5 and a constant class,
    ``across_seeds`` sums that up, ``intervals`` resamples test groups and has
    both rules and both differences, paired by draw; ``baseline`` is the
    constant class of the training prior, ``support`` and ``resolution`` say
    what the test part can show. ``runs`` are what ``check_runs`` takes. A
    manifest that breaks a rule is refused; without ``strict`` it is measured as
    it is, an empty one too, and what it doesn't define is null or has no row.
    The fixed threshold is judged even where none can be selected.
    """
    spark, stage = manifest.sparkSession, Stage(manifest.sparkSession, "measure")
    if strict:
        contracts.check_manifest(manifest)
    check_runs(manifest, **runs)
    # texts that are missing are no common content
    contracts.require(contracts.in_several_groups(manifest if strict else manifest.where("content_hash IS NOT NULL")), "test content in several groups")
    if strict and scores.select("seed").distinct().limit(2).count() < 2:
        raise ValueError("two or more seeds are needed")
    named = scores.select("seed", F.concat(F.lit("seed_"), F.col("seed").cast("string")).alias("model"), "sample_id", "p")
    by_model = named.select("model", "sample_id", "p")
    cuts = stage.write(threshold.choose_threshold(judged(manifest, by_model, "validation")).select("model", "threshold"))
    test = stage.write(judged(manifest, by_model, "test").join(manifest.select("sample_id", "group"), "sample_id"))
    prior = manifest.where("split = 'train'").agg(F.avg("label").cast("double")).first()[0]
    constant = int(prior is not None and prior >= 0.5)
    rows = test.join(cuts, "model", "left").select("model", "group", "y", F.explode(F.array(*(F.struct(F.lit(n).alias("comparator"), (F.col("p") >= t).cast("int").alias("said")) for n, t in (("selected", F.col("threshold")), ("fixed", F.lit(0.5)))))).alias("x")).select("model", "group", "y", "x.*").where("said IS NOT NULL")
    # numbers in the order of the groups' names, from a range-partitioned sort
    groups = manifest.where("split = 'test'").select("group").distinct().repartitionByRange("group").sortWithinPartitions("group")
    numbered = stage.write(groups.withColumn("number", F.monotonically_increasing_id()))
    sums = stage.write(resampling.group_sums(rows.join(numbered, "group").select(F.col("number").alias("group"), F.col("model").alias("seed"), "comparator", "y", "said")))
    total = sums.groupBy("seed", "comparator").agg(*(F.sum(c).alias(c) for c in ("P", "N", "tp", "tn")))
    values = total.select(F.col("seed").alias("model"), "comparator", ((F.col("tp") / F.nullif(F.col("P"), F.lit(0)) + F.col("tn") / F.nullif(F.col("N"), F.lit(0))) / 2).alias("value"))
    wide = values.groupBy("model").pivot("comparator", ["selected", "fixed"]).agg(F.first("value"))
    per_seed = stage.write(wide.join(cuts, "model").withColumns({"delta": F.col("selected") - F.col("fixed"), "baseline": F.lit(0.5), "over_baseline": F.col("selected") - 0.5}))
    across = resampling.across_seeds(per_seed.unpivot("model", ["selected", "fixed", "delta", "over_baseline"], "metric", "value"))
    counts = manifest.where("split = 'test'").groupBy("label").agg(F.count("*").alias("n"))
    return {
        "per_seed": per_seed,
        "across_seeds": across,
        "intervals": resampling.bootstrap(sums, repetitions, seed, kind, paired=True, least=2 if strict else 0),
        "baseline": spark.createDataFrame([(prior, constant)], "prior double, constant_class int"),
        "support": identity.group_support(manifest.where("split = 'test'"), "sample_id", "group", "content_hash", strict),
        "resolution": counts.withColumn("step", 0.5 / F.col("n")),
    }


def _cohort_tables(cohort: dict[str, DataFrame]) -> dict[str, DataFrame]:
    record = json.dumps(cohort_record(cohort), sort_keys=True)
    return {k: v for k, v in cohort.items() if k != "files"} | {"record": cohort["included"].sparkSession.createDataFrame([(record,)], "record string")}


def publish_cohort(cohort: dict[str, DataFrame], path: str, source: str | None = None) -> None:
    """The cohort's tables and its record in one new folder, all or none.

    With the ``source`` folder given, it and the target must be apart, and its
    files are read once more before the folder appears: case files and images,
    excluded ones too, must still be what they were, and none may have come.
    """
    spark, tables_of = cohort["included"].sparkSession, _cohort_tables(cohort)
    if source is None:
        sinks.publish_all(tables_of, path)
        return
    contracts.check_apart(source, path)

    def unchanged() -> None:
        now = tables.inventory(spark, source).select("name", "sha256", "size")
        contracts.require(contracts.difference(cohort["files"].select(*now.columns), now), "source files changed during the import")

    sinks.publish_all(tables_of, path, unchanged)

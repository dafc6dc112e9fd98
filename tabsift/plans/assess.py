"""The whole assessment of one dataset, and of a folder of datasets."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsift.config import CONFIG, DATA_EXTENSIONS, DOCUMENTATION_COMPONENTS, LOADABLE_EXTENSIONS, STANDARDISATION_COMPONENTS
from tabsift.dataset import Dataset, at_once, small_table, with_row_id
from tabsift.functions import exprs as X
from tabsift.operators import accuracy, anomaly, injection, missing, privacy, reuse, roles, scoring, triage
from tabsift.operators.frequency import column_measures
from tabsift.sources import commits, files


@dataclass(frozen=True)
class Profiled:
    """A dataset after the one barrier: per-column statistics, codes, profiles and routed columns."""

    ds: Dataset
    stats: DataFrame
    sentinels: dict[str, list[str]]
    semantic: DataFrame
    uniform: DataFrame
    policies: dict[str, list[str]]


def profile(ds: Dataset, evidence: DataFrame | None = None, infer: bool = True) -> Profiled:
    """Statistics, automatic metadata and both profiles; everything here has one row per column."""
    stats, sentinels = roles.column_stats(ds)
    if infer:
        ds = roles.apply_auto_metadata(ds, stats)
    semantic = small_table(roles.semantic_profile(stats, ds.metadata, ds.config, evidence))
    uniform = small_table(roles.uniform_profile(stats, ds.config))
    return Profiled(ds, stats, sentinels, semantic, uniform, roles.routing(semantic, stats))


def accuracy_issues(p: Profiled) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All issues found without detectors, and the scores of their components as one-row tables."""
    ds = p.ds
    structural = small_table(accuracy.structural_issues(ds, p.stats, p.semantic))
    n_rows = p.stats.agg(F.max("n_rows")).first()[0] or 0
    domain = small_table(accuracy.domain_counts(ds))
    rules = small_table(accuracy.rule_counts(ds))
    variants = small_table(accuracy.category_variants(ds, accuracy.category_columns(p.semantic)))
    scores = {"structural": accuracy.structural_score(structural, n_rows * len(ds.columns)),
              "domain": accuracy.domain_score(accuracy.domain_features(domain)),
              "rules": accuracy.consistency_score(rules), "categories": accuracy.category_score(variants)}
    issues = accuracy.union_issues([structural, accuracy.domain_issues(domain), accuracy.consistency_issues(rules),
                                    accuracy.category_issues(variants)])
    return issues, scores


def readiness(p: Profiled, confirmed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Facets, component detail, baseline comparison and issues of the reuse dimension."""
    ds, config = p.ds, p.ds.config
    spark = ds.df.sparkSession
    document = reuse.documentation_frame(ds)
    details, facets, issues = {}, {}, []
    for name, parts in (("documentation", DOCUMENTATION_COMPONENTS), ("standardisation", STANDARDISATION_COMPONENTS)):
        details[name] = small_table(reuse.hybrid_detail(
            reuse.rule_scores(document, parts, ds.metadata, config, confirmed), reuse.text_scores(document, parts, config), config))
        facets[name] = reuse.hybrid_facet(details[name])
        issues.append(reuse.facet_issues(facets[name], name))
    details["privacy"] = small_table(privacy.privacy_components(ds, document))
    details["machine_readability"] = reuse.machine_readability(p.semantic, ds.columns, ds.encoding_note, config)
    totals = {n: details[n].agg(X.clip01(F.sum("weighted_score")).alias("score")).first()["score"] for n in ("privacy", "machine_readability")}
    doc, std = facets["documentation"].first(), facets["standardisation"].first()
    score = {"documentation": F.lit(doc["score"]), "standardisation": F.lit(std["score"]),
             "privacy": F.lit(totals["privacy"]), "machine_readability": F.lit(totals["machine_readability"])}
    issues.append(privacy.privacy_issues(ds, document))
    headers = reuse.header_issues(ds.columns, ds.encoding_note)
    if headers:
        issues.append(spark.createDataFrame(headers, accuracy.ISSUE))
    one = spark.range(1)
    return {"reuse_facets": one.select(F.inline(reuse.facet_table(score, config))),
            "reuse_component_detail": reuse.union_details({k: v.drop("doc_id") for k, v in details.items()}),
            "reuse_baseline_comparison": one.select(F.inline(reuse.readiness_baseline(
                score["documentation"], score["standardisation"], F.lit(doc["rule_mean"]), F.lit(std["rule_mean"]),
                score["privacy"], score["machine_readability"], config))),
            "issues": small_table(accuracy.union_issues(issues)),
            "k_anonymity": small_table(privacy.k_anonymity(ds.df, ds.metadata["quasi_identifiers"], config))}


def assess(ds: Dataset, evidence: DataFrame | None = None, confirmed: DataFrame | None = None, evaluate: bool = True) -> dict[str, DataFrame]:
    """Every result table of one dataset, keyed by table name and labelled with the dataset.

    ``evaluate=False`` leaves out the error injection and the routing ablation, which no score depends on.
    """
    spark, config = ds.df.sparkSession, ds.config
    p = profile(ds, evidence)
    ds = p.ds
    n_rows = p.stats.agg(F.max("n_rows")).first()[0] or 0
    selection = roles.check_selection(p.semantic, ds.metadata, config)
    comparison = roles.compare_profiles(p.semantic, p.uniform)

    routed = p.policies if evaluate else dict.fromkeys(p.policies, p.policies["transformer_augmented_routing"])
    miss, c_components, (a_issues, a_scores), generic, ablation, ready = at_once([
        lambda: small_table(missing.missingness(ds, p.sentinels)), lambda: small_table(missing.completeness_components(ds, p.sentinels)), lambda: accuracy_issues(p),
        lambda: anomaly.detect(ds, p.policies["uniform_dtype_routing"], p.sentinels, False, n_rows),
        lambda: injection.ablation_detections(ds, routed, p.sentinels, n_rows), lambda: readiness(p, confirmed)])
    semantic = ablation["transformer_augmented_routing"]
    policies = anomaly.policy_comparison(spark, generic, semantic)

    values = {k: v.first()["score"] for k, v in a_scores.items()}
    confidence = p.semantic.agg(F.coalesce(F.avg("role_confidence"), F.lit(1.0)).alias("c")).first()["c"]
    a_score = policies.where("hitl_prioritisation = 'semantic_review_candidates'").first()["A_anomaly_score"]
    parts = {"structural": values["structural"], "domain": values["domain"], "anomaly": a_score,
             "inconsistency": min(values["rules"], values["categories"]), "schema_confidence": confidence}
    one = spark.range(1)
    a_components = one.select(F.inline(scoring.component_rows({k: F.lit(v) for k, v in parts.items()}, config["scoring"]["A"])))
    facet = {r["facet"]: r["score"] for r in ready["reuse_facets"].collect()}
    total = {"C": c_components, "A": a_components, "R": ready["reuse_facets"]}
    dims = {d: t.agg(X.clip01(F.sum("weighted_score")).alias("s")).first()["s"] for d, t in total.items()}
    scores = one.select(*[F.lit(dims[d]).alias(d) for d in ("A", "C", "R")])

    issues = small_table(accuracy.union_issues([missing.completeness_issues(ds, miss), a_issues,
                                                anomaly.anomaly_issue(spark, semantic), ready["issues"]]))
    register = triage.triage_register(issues, p.semantic, ds.metadata, config, ds.name)

    k = ready["k_anonymity"].first()
    limits = config["scoring"]["thresholds"]
    with_composite = scores.select("*", scoring.composite_index(config).alias("composite"))
    composite = with_composite.first()["composite"]
    text_method = ready["reuse_component_detail"].where("text_method is not null").agg(F.first("text_method").alias("m")).first()["m"]
    quality = one.select(
        F.lit(int(n_rows)).cast("long").alias("rows"), F.lit(len(ds.columns)).cast("long").alias("columns"),
        *[F.lit(dims[d]).alias(f"{d}(D)") for d in ("C", "A", "R")], F.lit(composite).alias("composite_quality_index"),
        *[F.lit(parts[x]).alias(f"A_{x}") for x in ("structural", "domain", "anomaly", "inconsistency")],
        F.lit(confidence).alias("schema_confidence"), *[F.lit(v).alias(f"R_{f}") for f, v in facet.items()],
        F.lit(k["min_equivalence_class"]).cast("long").alias("k_anonymity_min_class"),
        F.lit(k["at_risk_fraction"]).cast("double").alias("k_anonymity_at_risk_fraction"),
        F.lit(text_method or "none").alias("reuse_similarity_method"),
        *[F.lit(bool(v >= limits[d])).alias(f"{d}_meets_threshold") for d, v in (*dims.items(), ("composite", composite))],
        F.lit(issues.count()).alias("n_triage_candidates"),
        F.lit("embedding" if evidence is not None else "lexical_distributional_heuristic").alias("semantic_inference_method"))
    result = {
        "schema_profile": p.semantic, "uniform_profile": p.uniform, "rq1_check_selection_map": selection,
        "semantic_vs_uniform_profile": comparison, "completeness_components": c_components,
        "missingness_comparison": missing.missingness_effect(miss), "accuracy_components": a_components,
        "domain_feature_scores": accuracy.domain_features(small_table(accuracy.domain_counts(ds))),
        "anomaly_baseline_comparison": policies, "reuse_facets": ready["reuse_facets"],
        "reuse_component_detail": ready["reuse_component_detail"], "reuse_baseline_comparison": ready["reuse_baseline_comparison"],
        "issues_all": issues, "hitl_triage_register": register.drop("dataset"), "hitl_triage_summary": triage.triage_summary(issues),
        "hitl_validation_sample": triage.review_sample(ds, semantic.flags), "weight_sensitivity": scoring.weight_sensitivity(scores, config),
        "rq2_semantic_vs_uniform": scoring.semantic_vs_uniform(comparison, policies, miss, ready["reuse_baseline_comparison"]),
        "rq3_quality_profile": quality,
    }
    if evaluate:
        result.update(evaluation(p, evidence, n_rows, generic, ablation))
    if generic.flags is not None:
        result["generic_anomaly_flags"] = generic.flags
    if semantic.flags is not None:
        result["semantic_hitl_anomaly_flags"] = semantic.flags
        result["anomaly_preprocessing_report"] = semantic.footprint
    detected = [(k, c) for k, cs in ds.auto.items() for c in cs]
    result["auto_inferred_metadata"] = spark.createDataFrame(detected, "kind string, column string")
    return {name: df.select(F.lit(ds.name).alias("dataset"), "*") for name, df in result.items()}


def evaluation(p: Profiled, evidence: DataFrame | None, n_rows: int, generic: anomaly.Detection,
               ablation: dict[str, anomaly.Detection]) -> dict[str, DataFrame]:
    """Controlled errors and routing ablation: how well the checks themselves work."""
    ds = p.ds

    def reprofile(other: Dataset):
        again = profile(other, evidence, infer=False)
        return column_measures(other).collect(), again.sentinels, again.policies

    before = {"generic": generic, "semantic": ablation["transformer_augmented_routing"]}
    burden = injection.ablation_burden(ds, ablation)
    return {"controlled_error_baseline": injection.controlled_error_baseline(ds, reprofile, n_rows, before),
            "routing_ablation": burden,
            "routing_ablation_controlled_errors": injection.ablation_errors(ds, ablation, column_measures(ds).collect(), p.sentinels),
            "routing_ablation_contrasts": injection.ablation_contrasts(burden)}


STATUS = "dataset string, status string, error string"


def run_each(spark: SparkSession, jobs: dict, workers: int = 1) -> tuple[DataFrame, dict]:
    """Run named jobs, up to ``workers`` at once; a failure is recorded with its message and the others go on."""
    def attempt(job):
        try:
            return job(), None
        except Exception as problem:  # one dataset must not stop the rest
            return None, f"{type(problem).__name__}: {str(problem).strip().splitlines()[0] if str(problem).strip() else ''}".strip(": ")

    with ThreadPoolExecutor(workers) as pool:
        done = dict(zip(jobs, pool.map(attempt, jobs.values())))
    status = [(name, "ok" if error is None else "failed", error) for name, (_, error) in done.items()]
    return spark.createDataFrame(status, STATUS), {name: result for name, (result, error) in done.items() if error is None}


#: Lines that a separator is looked for in where quoted cells go on over several.
OPEN_LINES = 2_000


def load_file(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A delimited file as text columns plus its encoding note.

    The separator comes from the first lines; one distributed pass over the lines settles encoding, decimal mark and whether a quoted
    cell holds a line break.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind in DATA_EXTENSIONS and kind not in LOADABLE_EXTENSIONS:
        raise ValueError(f"{name}: files of type {kind} can't be read")
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    facts = lines.agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
                      F.coalesce(F.bool_or(F.col("value").rlike(r"\d,\d")), F.lit(False)).alias("comma"),
                      F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("open")).first()
    head = [r["value"] for r in lines.where(X.strip(F.col("value")) != "").take(OPEN_LINES if facts["open"] else files.SNIFF_LINES)]
    if facts["open"]:                                                      # line breaks in quoted cells end no row
        head = [re.sub('"[^"]*"', '""', "\n".join(head))]
    sample = spark.createDataFrame([("\n".join(head), name)], "text string, name string")
    separator = sample.select(files.sniff_separator(F.col("text"), F.col("name")).alias("s")).first()["s"]
    note = "utf8_semicolon" if separator == ";" else "utf8"
    note = note if facts["utf8"] else "non_utf8_latin1_fallback"
    decimal = "," if separator != "," and facts["comma"] else "."
    return files.read_delimited(spark, path, separator, decimal, "UTF-8" if facts["utf8"] else "ISO-8859-1", facts["open"]), note


#: Datasets of a folder that are assessed at once.
WORKERS = 4


def dataset_names(names: list[str]) -> dict[str, str]:
    """A name for each file: its stem, or the whole file name where several files share one."""
    stems = Counter(n.rsplit(".", 1)[0] for n in names)
    return {n: n if stems[n.rsplit(".", 1)[0]] > 1 else n.rsplit(".", 1)[0] for n in names}


def assess_folder(spark: SparkSession, data_dir: str, metadata_dir: str | None, output: str, config: dict | None = None) -> DataFrame:
    """Assess every accepted file of a folder, write all tables, and answer one status row per file.

    A dataset's tables become visible together. A dataset whose file, metadata and configuration are those of its tables is finished and not assessed again,
    so a run that was stopped goes on where it stopped.
    """
    config = config or CONFIG
    found = files.list_datasets(files.folder_listing(spark, data_dir), cap=config["max_datasets"]).collect()
    called = dataset_names([row["name"] for row in found])
    paths = {called[row["name"]]: row["path"] for row in found}
    metadata = attached_metadata(spark, list(paths), metadata_dir) if metadata_dir else {}
    done = commits.finished(spark, output)

    def job(name, path):
        def run():
            source = commits.fingerprint(spark, path, config, metadata.get(name))
            if done.get(name) == source:
                return
            df, note = load_file(spark, path)
            ds = Dataset.of(name, with_row_id(df), "row_id", metadata.get(name), config, note)
            result = assess(ds)
            commits.commit(spark, output, name, {**result, "all_dataset_quality_profiles": result["rq3_quality_profile"]}, source)
        return run

    return run_each(spark, {name: job(name, path) for name, path in paths.items()}, WORKERS)[0]


def attached_metadata(spark: SparkSession, names: list[str], folder: str) -> dict[str, dict]:
    """Metadata per dataset: merged JSON documents plus the text of related documentation.

    Documents of all datasets are read and kept once, under ``*``, and meet each dataset's own on the driver, where metadata lives.
    """
    rows = files.file_rows(spark, folder)
    datasets = spark.createDataFrame([(n,) for n in names], "dataset string")
    related = small_table(files.relate_documents(datasets, rows, len(names)).distinct()).join(rows, "name")
    bodies = related.where(files.extension(F.col("name")) == ".json").withColumn("body", files.decode_text(F.col("content")))
    structured, texts = defaultdict(list), defaultdict(list)
    for r in files.merged_metadata(bodies).collect():
        structured[r["dataset"]].append(r)
    for r in files.documentation_text(related).where(X.strip(F.col("text")) != "").select("dataset", "name", "text").collect():
        texts[r["dataset"]].append((r["name"], r["text"]))
    result = {}
    for name in names:
        merged = files.metadata_dict(structured[files.EVERY_DATASET] + structured[name])
        documents = sorted({*texts[name], *texts[files.EVERY_DATASET]})
        if documents:
            chunks = "\n\n".join(f"[{n}]\n{text}" for n, text in documents)
            merged["documentation_text"] = (str(merged["documentation_text"]) + "\n\n" + chunks).strip()
        result[name] = merged
    return result

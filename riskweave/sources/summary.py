"""One Markdown report over the JSON results of training, data, evaluation, calibration, quantisation, sizes, latencies and baselines."""

from __future__ import annotations

from . import load_json, mib, percent

INPUTS = ("training", "validation", "evaluation", "calibration", "quantization", "model_sizes", "edge", "teacher_baseline")


def _table(names: list[str], rows: list[list]) -> str:
    shown = lambda x: "not measured" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(shown, r)) + " |" for r in rows)])


def summary(results: dict[str, dict]) -> str:
    """The report from the eight results by name (INPUTS); a missing one is an error."""
    training, data, evaluation, calibration, quantization, sizes, edge, baseline = (results[n] for n in INPUTS)
    mean = lambda kind, name: sum(x[kind][name] for x in calibration.values()) / max(len(calibration), 1)
    counts = ", ".join(f"{k} {v:,}" for k, v in data["counts"].items())
    tasks = [[t, m["f1"], m["recall"], m["false_positive_rate"], m["false_negative_rate"], m["support"]] for t, m in evaluation["tasks"].items()]
    latency = baseline.get("latency_p50_ms", {})
    models = [[n, m["macro_f1"], m["macro_recall"], m["mean_ece"], next((v for k, v in latency.items() if k.startswith(n)), None)] for n, m in baseline.items() if isinstance(m, dict) and "macro_f1" in m]
    parts = [
        "# Report",
        f"Parameters {training['parameters']:,}, of which {training['trainable_parameters']:,} were trained, with {training['teacher_examples']:,} teacher targets. Rows: {counts}.",
        f"## Held-out rows ({evaluation['examples']:,})\n\nMean accuracy {evaluation['accuracy']:.3f}, macro F1 {evaluation['macro_f1']:.3f}.\n\n" + _table(["task", "F1", "recall", "false positive rate", "false negative rate", "support"], tasks),
        "## Baselines\n\n" + _table(["model", "macro F1", "macro recall", "mean ECE", "p50 ms"], models) + "\n\n" + "Rules alone, F1: " + ", ".join(f"{t} {m['f1']:.3f}" for t, m in evaluation["baseline_rules"].items()) + ".",
        "## Calibration\n\n" + _table(["measure", "raw", "calibrated"], [[n, mean("raw", n), mean("calibrated", n)] for n in ("ece", "brier", "nll")]),
        "## Sizes\n\n" + _table(["artifact", "size", "of the largest"], [[k.removesuffix("_bytes"), mib(v), percent(v / max(sizes.values()))] for k, v in sizes.items()]),
        "## Latency\n\n" + _table(["backend", "cold start ms", "warm p50 ms", "memory MiB"], [[k, v["cold_start_ms"], v["warm_p50_ms"], v["rss_delta_mib_approx"]] for k, v in edge.items()]),
        f"The quantised backend changes {percent(quantization['action_disagreement'])} of final actions on {quantization['examples']:,} rows.",
    ]
    return "\n\n".join(parts) + "\n"


def read_results(paths: dict[str, str]) -> dict[str, dict]:
    return {name: load_json(paths[name]) for name in INPUTS}

"""One text to its decision record as JSON.

python -m riskweave --text TEXT [--metadata JSON] [--backend lexicon|FOLDER|FILE] [--temperatures FILE] [--policy FILE]
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from .constants import TASKS, Policy
from .functions.policy import read_policy
from .operators.heads import Heads
from .operators.surrogate import load_heads
from .plans.analyze import analyze_text, head_scores, lexicon_scores, trained_scores
from .sources import load_temperatures


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="riskweave")
    parser.add_argument("--text", required=True)
    parser.add_argument("--metadata", type=json.loads, default={}, help="flags as a JSON object")
    parser.add_argument("--backend", default="lexicon", help="lexicon, a folder of saved heads, or a JSON file of heads trained together")
    parser.add_argument("--temperatures", help="a JSON file of temperatures by task; 1 where it names none")
    parser.add_argument("--policy", help="a YAML file of thresholds; the built-in one where it names none")
    given = parser.parse_args(arguments)
    if not isinstance(given.metadata, dict):
        parser.error("metadata is to be a JSON object")
    own = spark is None
    spark = spark or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if given.backend == "lexicon":
            scores = lexicon_scores
        elif os.path.isfile(given.backend):
            scores = trained_scores(Heads.load(given.backend))
        else:
            scores = head_scores(load_heads(given.backend, TASKS))
        temperatures = load_temperatures(given.temperatures) if given.temperatures else None
        policy = read_policy(given.policy) if given.policy else Policy()
        print(json.dumps(analyze_text(spark, given.text, given.metadata, scores=scores, temperatures=temperatures, policy=policy), ensure_ascii=False, indent=2))
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    main()

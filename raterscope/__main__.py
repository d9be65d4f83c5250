"""Command line: ``python -m raterscope <stage> ...`` or the same through ``spark-submit``."""

from __future__ import annotations

import argparse

from .plans import jobs
from .schemas import STATISTICS
from .session import get_session


def _level(text: str) -> float | str:
    return text if text == "discover" else float(text)


def _count(text: str) -> int | None:
    return None if text == "all" else int(text)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="raterscope")
    parser.add_argument("--master", help="only for local runs; a cluster sets its own")
    stages = parser.add_subparsers(dest="stage", required=True)

    def stage(name: str, *paths: str) -> argparse.ArgumentParser:
        sub = stages.add_parser(name)
        for path in paths:
            sub.add_argument(path)
        return sub

    qualify = stage("qualify", "ratings_path", "out")
    qualify.add_argument("--k", type=int, default=300)
    qualify.add_argument("--min-count", type=int, default=300)
    qualify.add_argument("--seed", type=int, default=42)
    qualify.add_argument("--multi-line", action="store_true", help="titles hold line breaks")
    qualify.add_argument("--rejects", help="folder for lines that do not fit")
    requests = stage("request_file", "ratings_path", "out")
    requests.add_argument("--n-users", type=int, default=4000)
    requests.add_argument("--seed", type=int, default=42)
    requests.add_argument("--multi-line", action="store_true", help="titles hold line breaks")
    requests.add_argument("--rejects", help="folder for lines that do not fit")
    answers = stage("answer_file", "prefix", "out", "audit_out")
    answers.add_argument("--min-rating", type=float)
    answers.add_argument("--max-rating", type=float)
    statistics = stage("statistics_table", "ratings_path", "out")
    statistics.add_argument("--synthetic", action="store_true", help="columns of machine ratings")
    statistics.add_argument("--features", nargs="+", default=STATISTICS, choices=STATISTICS)
    statistics.add_argument("--levels", nargs="+", type=_level, help="the rating scale, or: discover")
    statistics.add_argument("--rejects", help="folder for lines that do not fit")
    delivery = stage("add_delivery", "ratings_path", "state", "delivery")
    delivery.add_argument("--levels", nargs="+", type=float, default=(1, 2, 3, 4, 5), help="the rating scale")
    delivery.add_argument("--synthetic", action="store_true", help="columns of machine ratings")
    delivery.add_argument("--rejects", help="folder for lines that do not fit")
    delivered = stage("delivered_statistics", "state", "out")
    delivered.add_argument("--levels", nargs="+", type=float, default=(1, 2, 3, 4, 5), help="the rating scale")
    delivered.add_argument("--features", nargs="+", default=STATISTICS, choices=STATISTICS)
    labelled = stage("labelled_table", "human_path", "machine_path", "out")
    labelled.add_argument("--n-human", type=_count, default=4000, help="a number, or: all")
    labelled.add_argument("--seed", type=int, default=42)
    labelled.add_argument("--codec", default="uncompressed")
    labelled.add_argument("--rejects", help="folder for raters that are left out")
    labelled.add_argument("--features", nargs="+", default=STATISTICS, choices=STATISTICS)
    train = stage("train", "dataset_path", "out", "models_folder")
    train.add_argument("--rounds", type=int, default=100)
    train.add_argument("--trees", type=int, default=100)
    train.add_argument("--svm-iterations", type=int, default=20)
    train.add_argument("--folds", type=int, default=6)
    train.add_argument("--seed", type=int, default=42)
    train.add_argument("--curve-steps", type=int, default=10)
    score = stage("score", "model_path", "ratings_path", "out")
    score.add_argument("--user-col")
    score.add_argument("--rating-col")
    score.add_argument("--target-user")
    score.add_argument("--combine-all", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> None:
    arguments = vars(_parser().parse_args(argv))
    stage, master = arguments.pop("stage"), arguments.pop("master")
    if (levels := arguments.get("levels")) and "discover" in levels:
        arguments["levels"] = "discover"
    spark = get_session(f"raterscope {stage}", master)
    result = getattr(jobs, stage)(spark, **arguments)
    print(result) if isinstance(result, str) else result.show(20, truncate=False)


if __name__ == "__main__":
    main()

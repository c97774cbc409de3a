"""Command line: lint, verify-manifest, run-comparison, canaries."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from collections.abc import Sequence
from datetime import date
from pathlib import Path

from tempora import __version__
from tempora.plans.strategy import StrategyConfig


def build_parser() -> argparse.ArgumentParser:
    # Names, flags and defaults are the interface.
    p = argparse.ArgumentParser(prog="tempora")
    p.add_argument("--version", action="version", version=f"tempora {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    lint = sub.add_parser("lint", help="look for look-ahead in feature code")
    lint.add_argument("files", nargs="+", type=Path)
    verify = sub.add_parser("verify-manifest", help="hash a run's inputs again")
    verify.add_argument("manifest", type=Path)
    verify.add_argument("--repo-root", type=Path, default=Path("."))
    sub.add_parser("canaries", help="run the canary tests")
    run = sub.add_parser("run-comparison", help="leaky and corrected pipeline side by side")
    run.add_argument("--start-date", "--start", dest="start_date", required=True, type=date.fromisoformat)
    run.add_argument("--end-date", "--end", dest="end_date", required=True, type=date.fromisoformat)
    run.add_argument("--tickers", nargs="+", default=["AAPL", "MSFT", "NVDA", "META", "GOOGL"])
    run.add_argument("--top-k", type=int, default=3)
    run.add_argument("--cost-bps", type=float, default=5.0)
    run.add_argument("--initial-capital", type=float, default=1.0)
    run.add_argument("--rebalance-frequency", choices=("daily", "weekly"), default="daily")
    run.add_argument("--weekly-rebalance-day", type=int, default=0)
    run.add_argument("--synthetic", "--demo", dest="synthetic", action="store_true")
    run.add_argument("--require-price-above", type=float)
    run.add_argument("--level-column", default="close")
    run.add_argument("--data-root", type=Path, default=Path("data/raw"))
    run.add_argument("--prices-path", type=Path)
    run.add_argument("--preadjusted-prices-path", type=Path)
    run.add_argument("--splits-path", type=Path)
    run.add_argument("--artifacts-root", type=Path, default=Path("artifacts/runs"))
    run.add_argument("-v", "--verbose", action="store_true")
    run.add_argument("--dry-run", action="store_true")
    return p


def _lint(args: argparse.Namespace) -> int:
    from tempora.tools.lint import lint_file

    n = 0
    for f in args.files:
        if not f.is_file():
            raise ValueError(f"{f} is no file")
        for x in lint_file(f):
            n += 1
            print(f"{f}:{x.lineno}:{x.col_offset} {x.rule} {x.message}; {x.advice}\n    {x.snippet}")
    return int(n > 0)


def _verify(args: argparse.Namespace) -> int:
    from tempora.tools.manifest import verify_manifest

    found = verify_manifest(args.manifest, args.repo_root)
    for name, ok in found.checks:
        print("ok  " if ok else "BAD ", name)
    for name in found.skipped:
        print("not checked", name)
    return int(not found.passed)


def _run(args: argparse.Namespace) -> int:
    from tempora.operators.entity import normalise_tickers
    from tempora.plans import runner, synthetic
    from tempora.plans.features import DEFAULT_FEATURES
    from tempora.plans.metrics import TRADING_DAYS, tear_sheet
    from tempora.plans.simulation import SimulationConfig
    from tempora.session import get_session
    from tempora.sources.storage import optional_splits, read_parquet
    from tempora.tools.manifest import build_manifest, snapshot, write_manifest
    from tempora.tools.report import write_report

    if args.start_date > args.end_date:
        raise ValueError("the start lies after the end")
    ids = tuple(runner.universe_ids(normalise_tickers(args.tickers)))
    if args.dry_run:
        print(json.dumps({"sec_ids": ids, "start": str(args.start_date), "end": str(args.end_date)}))
        return 0
    spark = get_session()
    inputs, leaky_views, corrected_views, eps = [], (), (), None
    if args.synthetic:
        raw, adjusted, splits, filings = synthetic.market(spark, ids, args.start_date, args.end_date)
        keep, eps = ["sec_id", "metric_value", "known_from", "ingestion_seq"], synthetic.EPS_SCREEN
        inputs = [{"path": "synthetic", "seed": synthetic.SEED}]
        leaky_views, corrected_views = (synthetic.leaky_fundamentals(filings).select(*keep),), (filings.select(*keep, "known_to"),)
    else:
        prices = args.prices_path or args.data_root / "market_ohlcv"
        if args.preadjusted_prices_path is None:
            raise ValueError("--preadjusted-prices-path is needed: there is no network here")
        split_path = args.splits_path or args.data_root / "corporate_actions"
        raw = runner.universe_between(read_parquet(spark, str(prices), "prices"), ids, args.start_date, args.end_date)
        adjusted = runner.universe_between(read_parquet(spark, str(args.preadjusted_prices_path), "pre-adjusted prices"), ids, args.start_date, args.end_date)
        splits = optional_splits(spark, str(split_path), ids, args.end_date)
        for frame in (raw, adjusted):
            runner.require_tickers(frame, ids)
        inputs = snapshot([prices, args.preadjusted_prices_path, *([split_path] if split_path.exists() else [])])
    strategy = StrategyConfig(args.top_k, args.rebalance_frequency, args.weekly_rebalance_day, eps, args.level_column, args.require_price_above)
    arms = runner.run_comparison(
        runner.observation_grid(raw, ids), raw, adjusted, splits, strategy, SimulationConfig(args.cost_bps, initial_capital=args.initial_capital),
        leaky_views=leaky_views, corrected_views=corrected_views, leaky_universe=ids,
    )
    sheet = tear_sheet(arms.leaky.simulation, arms.corrected.simulation, 52 if args.rebalance_frequency == "weekly" else TRADING_DAYS, args.initial_capital)
    print(sheet.render())
    results = {n: getattr(sheet, n).as_dict() for n in ("leaky", "corrected", "delta")}
    parameters = {k: v for k, v in vars(args).items() if k not in ("command", "verbose", "dry_run", "artifacts_root")}
    manifest = build_manifest(input_snapshot=inputs, feature_names=DEFAULT_FEATURES, parameters=parameters, results=results)
    folder = write_manifest(manifest, args.artifacts_root).parent
    for name in ("leaky", "corrected"):
        arm = getattr(arms, name)
        arm.features.write.mode("overwrite").parquet(str(folder / f"features_{name}"))
        arm.weights.write.mode("overwrite").parquet(str(folder / f"weights_{name}"))
        arm.simulation.write.mode("overwrite").parquet(str(folder / f"equity_{name}"))
    (folder / "metrics.json").write_text(json.dumps(results, indent=2))
    (folder / "report.txt").write_text(sheet.render() + "\n")
    write_report(folder / "report.pdf", manifest["run_id"], sheet, {"leaky": arms.leaky.simulation, "corrected": arms.corrected.simulation})
    print(folder)
    return 0


def _canaries(_: argparse.Namespace) -> int:
    return subprocess.run([sys.executable, "-m", "pytest", "tests/test_canaries.py", "-q"], check=False).returncode


def main(argv: Sequence[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    try:
        return {"lint": _lint, "verify-manifest": _verify, "run-comparison": _run, "canaries": _canaries}[args.command](args)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

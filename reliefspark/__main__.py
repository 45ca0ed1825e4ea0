"""Command line: `run` applies an operator to a raster, `prepare` fills voids."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import api
from .operators.registry import NAMES, OPERATORS

#: Options of one operator whose name is not its parameter's. Customary spellings.
SPELLED = {
    "--mst-weights": ("multiscale_terrain", "weights"), "--vs-scales": ("visual_saliency", "scales"), "--surprise-scales": ("scale_space_surprise", "scales"),
    "--surprise-enhancement": ("scale_space_surprise", "enhancement"), "--fractal-radii": ("fractal_anomaly", "radii"), "--blur-radius": ("blur", "radius"),
    "--ml-azimuths": ("multi_light_uncertainty", "azimuths"), "--frangi-beta": ("frangi", "beta"), "--lic-length": ("lic", "length"), "--lic-composite": ("lic", "composite"),
    "--lic-sigma": ("lic", "flow_sigma"), "--pc-k": ("phase_congruency", "noise_k"), "--tv-iterations": ("tv_decomposition", "iterations"),
    "--tv-fidelity": ("tv_decomposition", "fidelity"), "--tv-component": ("tv_decomposition", "component"),
}


def numbers(text: str) -> tuple[float, ...]:
    return tuple(int(x) if float(x).is_integer() else float(x) for x in text.split(",") if x.strip())


def span(text: str) -> tuple[float, float]:
    low, high = (float(x) for x in text.split(","))
    if high <= low:
        raise argparse.ArgumentTypeError("range must rise")
    return low, high


def setting(text: str) -> tuple[str, object]:
    key, _, value = text.partition("=")
    try:
        return key, json.loads(value)
    except json.JSONDecodeError:
        return key, value


def _kind(default: object):
    if isinstance(default, bool):
        return lambda text: text.lower() in ("1", "true", "yes")
    if isinstance(default, str):
        return str
    return numbers if isinstance(default, tuple) else lambda text: numbers(text)[0]


def own_options() -> dict[str, tuple[str, object]]:
    """Option to parameter and default, for all parameters of all operators that are not common."""
    out = {}
    for op in OPERATORS.values():
        for name, default in op.params.items():
            if name not in ("radii", "weights"):
                out["--" + name.replace("_", "-")] = (name, default)
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="reliefspark")
    jobs = top.add_subparsers(dest="job", required=True)
    run = jobs.add_parser("run")
    prep = jobs.add_parser("prepare")
    for p in (run, prep):
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--force", action="store_true", help="replace an output that exists")
        p.add_argument("--tmp-dir", help="the shared folder, where spark.checkpoint.dir names none")
        p.add_argument("--log-level", default="WARN")
        p.add_argument("--no-progress", action="store_true")
        p.add_argument("--nodata", default="none" if p is run else "auto", help="auto, none, nan or a number")
    run.add_argument("--algorithm", "--algo", choices=NAMES, default="topousm_fast")
    run.add_argument("--radii", type=numbers)
    run.add_argument("--weights", type=numbers)
    run.add_argument("--mode", choices=("spatial", "local"), default="spatial")
    run.add_argument("--auto-radii", action=argparse.BooleanOptionalAction, default=True, help="radii from the raster's size where none are given; else radius 1")
    run.add_argument("--single-scale", action="store_true", help="the same as --mode local")
    run.add_argument("--approx", action="store_true", help="smooth at large radii on a coarser grid")
    run.add_argument("--nodata-threshold", type=float, help="share of voids from which a tile is skipped")
    run.add_argument("--keep-tiles", action="store_true", help="write a folder of tile files instead of one file")
    run.add_argument("--cog-only", action="store_true", help="build the output from encoded tiles that an earlier run has left")
    run.add_argument("--agg", choices=("mean", "min", "max", "sum", "stack"))
    run.add_argument("--pixel-size", type=numbers, help="one step, or signed steps x,y; degrees with --latitude")
    run.add_argument("--latitude", type=float, help="centre latitude of a raster in degrees")
    run.add_argument("--output-dtype", choices=api.DTYPES, default="float32")
    run.add_argument("--output-range", type=span)
    run.add_argument("--tile-size", "--chunk", type=int, help="side of a tile; it follows halo, memory and cores where none is given")
    for option, (name, default) in own_options().items():
        run.add_argument(option, dest="own_" + name, type=_kind(default), metavar="VALUE", help=f"default {default}")
    for option, (algorithm, name) in SPELLED.items():
        run.add_argument(option, dest="spelled_" + option.strip("-").replace("-", "_"), type=_kind(OPERATORS[algorithm].params[name] if OPERATORS[algorithm].params[name] is not None else ()), metavar="VALUE", help=f"{name} of {algorithm}")
    run.add_argument("--set", type=setting, action="append", default=[], metavar="NAME=VALUE", help="any parameter of the operator by its name")
    prep.add_argument("--fill-mode", choices=("enclosed", "all", "none"), default="enclosed")
    prep.add_argument("--coarse-max", type=int, default=2048, help="longest side of the overview that fills voids")
    prep.add_argument("--nodata-border-fraction", type=float, default=0.5)
    prep.add_argument("--nodata-sentinel-fraction", type=float, default=0.05)
    return top


def params_of(args: argparse.Namespace) -> dict:
    """What the options say about the operator; options of other operators are errors."""
    params = {k: v for k in ("radii", "weights", "agg") if (v := getattr(args, k)) is not None}
    params |= {k[4:]: v for k, v in vars(args).items() if k.startswith("own_") and v is not None}
    for option, (algorithm, name) in SPELLED.items():
        value = getattr(args, "spelled_" + option.strip("-").replace("-", "_"))
        if value is not None:
            if algorithm != args.algorithm:
                raise SystemExit(f"{option} belongs to {algorithm}")
            params[name] = value
    params |= dict(args.set)
    params["mode"] = "local" if args.single_scale or (not args.auto_radii and "radii" not in params) else args.mode
    if args.approx:
        params["approx"] = True
    if args.nodata_threshold is not None:
        params["skip"] = args.nodata_threshold
    return params


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    build = SparkSession.builder.appName("reliefspark").config("spark.ui.showConsoleProgress", str(not args.no_progress).lower())
    if args.tmp_dir:
        build = build.config("spark.checkpoint.dir", args.tmp_dir)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel(args.log_level)
    if args.job == "prepare":
        api.prepare_raster(spark, args.input, args.output, args.fill_mode, args.nodata, args.force, coarse=args.coarse_max, ring_share=args.nodata_border_fraction, sentinel_share=args.nodata_sentinel_fraction)
        return
    pixel = args.pixel_size and (args.pixel_size * 2)[:2]
    print(json.dumps(api.run_pipeline(spark, args.input, args.output, args.algorithm, nodata=args.nodata, output_dtype=args.output_dtype, override=args.output_range, overwrite=args.force, tile=args.tile_size, pixel_size=pixel, latitude=args.latitude, as_tiles=args.keep_tiles, resume=args.cog_only, **params_of(args))))


if __name__ == "__main__":
    main()

"""Plans of captures from the command line: ``python -m plumbline plan FOLDER --out FOLDER`` and ``python -m plumbline schema``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession


def lines(plans: DataFrame) -> list[str]:
    """A few lines on each document: rooms with their floors, heights and doorways, and what was found in them."""
    from pyspark.sql import functions as F

    from plumbline.plans import contract

    of = {}
    for r in contract.summary(plans).where("class IS NOT NULL").collect():  # a row a room and class
        of.setdefault((r["capture"], r["room"]), []).append(f"{r['n']} {r['class'].replace('_', ' ')}")
    out = []
    size = lambda m, unit: "not measured" if m is None or m["value"] is None else f"{m['value']:.2f} {unit} [{m['lo']:.2f}, {m['hi']:.2f}]" if m["lo"] is not None else f"{m['value']:.2f} {unit}"
    fields = F.transform("rooms", lambda r: F.struct(r["id"].alias("id"), r["floor_area"].alias("area"), r["ceiling_height"].alias("height"), F.size(r["walls"]).alias("walls"), F.size(r["openings"]).alias("doors")))
    for p in plans.select("capture", "tier", fields.alias("rooms")).orderBy("capture").collect():  # a row a capture
        out.append(f"{p['capture']} ({p['tier']}): {len(p['rooms'])} room(s)")
        for r in p["rooms"]:
            found = of.get((p["capture"], r["id"]))
            out.append(f"  {r['id']}: floor {size(r['area'], 'm2')}, ceiling {size(r['height'], 'm')}, {r['walls']} walls, {r['doors']} doorways" + (f", {', '.join(sorted(found))}" if found else ""))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description="Dimensioned floor plans of captures.")
    commands = parser.add_subparsers(dest="command", required=True)
    plan = commands.add_parser("plan", help="plans of one capture or of all that a pattern names")
    plan.add_argument("captures", help="folder of a capture, or a pattern for several")
    plan.add_argument("--out", default="out", help="folder for the documents and drawings")
    plan.add_argument("--replicates", type=int, default=20, help="replicates for the intervals")
    plan.add_argument("--seed", type=int, default=0)
    plan.add_argument("--no-drift", action="store_true", help="take poses as they are")
    commands.add_parser("schema", help="print the document's type")
    args = parser.parse_args(argv)

    from plumbline.functions.tables import writer
    from plumbline.plans import contract, lidar

    session = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    if args.command == "schema":
        print(contract.schema().json())
        return 0
    try:
        save = writer(session, "plan")
        plans = save(lidar.run(session, args.captures, save, correct_drift=not args.no_drift, reps=args.replicates, seed=args.seed))
    except FileNotFoundError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    contract.write(plans, f"{args.out}/plans")
    contract.drawing(plans).write.mode("overwrite").json(f"{args.out}/drawings")
    print("\n".join(lines(plans)))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: one text or file to JSON, by the rule planner."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from docjson.plans.extract import RulePlanner, extract
from docjson.settings import Settings


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Extract structured data from text as JSON.")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--text", "-t")
    source.add_argument("--file", "-f", type=Path)
    p.add_argument("--schema", "-s", type=Path)
    p.add_argument("--output", "-o", type=Path)
    p.add_argument("--pretty", "-p", action="store_true")
    p.add_argument("--max-iterations", type=int)
    p.add_argument("--quiet", "-q", action="store_true")
    a = p.parse_args(argv)
    try:
        text = a.text or a.file.read_text(encoding="utf-8")
        schema = json.loads(a.schema.read_text(encoding="utf-8")) if a.schema else None
    except (OSError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    s = Settings.from_env()
    if a.max_iterations:
        s = Settings(**{**s.__dict__, "max_iterations_per_chunk": a.max_iterations})
    result = extract(text, RulePlanner(), schema, s)
    if result["error"]:
        print(f"Error: {result['error']}", file=sys.stderr)
        return 1
    out = json.dumps(result["json_document"], indent=2 if a.pretty else None, ensure_ascii=False)
    if a.output:
        a.output.parent.mkdir(parents=True, exist_ok=True)
        a.output.write_text(out, encoding="utf-8")
        if not a.quiet:
            print(f"Result saved in: {a.output}")
    else:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

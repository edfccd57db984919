"""python -m loamgraph FILE [--jsonl]: the symbols of one source file."""

import json
import sys

from .functions.languages import parse


def main(args: list[str]) -> int:
    names = [a for a in args if a != "--jsonl"]
    if len(names) != 1:
        print(__doc__)
        return 2
    with open(names[0], encoding="utf-8", errors="replace") as f:
        found = parse(names[0], f.read())
    for name, kind, start, end, exported in found.symbols:
        if "--jsonl" in args:
            print(json.dumps({"name": name, "kind": kind, "startLine": start, "endLine": end, "isExport": exported}))
        else:
            print(f"{start}-{end} {kind} {name}{' (exported)' if exported else ''}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

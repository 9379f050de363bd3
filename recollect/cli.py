"""Command line of the memory."""

from __future__ import annotations

import argparse
import json

from recollect.plans.memory import Memory
from recollect.session import local_session
from recollect.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recollect", description="Memory of document folders as a knowledge graph.")
    p.add_argument("--root", default="recollect-memory", help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, *args: str, **flags):
        c = sub.add_parser(command)
        for a in args:
            c.add_argument(a)
        c.add_argument("--project")
        for f, kind in flags.items():
            c.add_argument("--" + f.replace("_", "-"), **({"action": "store_true"} if kind is bool else {"type": kind}))
        return c

    add("build", "source_dir", name=str, reset=bool, full=bool, max_files=int, prune=bool, verify=bool)
    add("update", source_dir=str)
    add("overview")
    add("query", "text", k=int, all=bool)
    add("expand", "entity", depth=int)
    add("stats")
    add("list")
    add("link", "into", "origin", query=str, k=int)
    add("export", "dest", graph=bool, mindmap=bool, as_context=str)
    add("mindmap", out=str)
    add("status", ask=bool)
    add("compact")
    return p


def main(argv: list[str] | None = None, memory: Memory | None = None) -> str:
    a = parser().parse_args(argv)
    m = memory or Memory(local_session(), a.root)
    dump = lambda x: json.dumps(x, indent=2, ensure_ascii=False, default=str)
    if a.command == "build":
        out = dump(m.build(a.source_dir, a.project or "default", a.name, not a.full, a.reset, a.max_files, a.prune, a.verify))
    elif a.command == "update":
        out = dump(m.update(m.sole(a.project), a.source_dir))
    elif a.command == "overview":
        out = m.overview(a.project)
    elif a.command == "query":
        out = m.query_markdown(a.text, a.project, a.k, "all" if a.all else "project")
    elif a.command == "expand":
        out = sinks.expand_markdown(a.entity, m.expand(a.entity, a.project, a.depth or 1))
    elif a.command == "stats":
        out = dump(m.stats(a.project))
    elif a.command == "list":
        out = dump([r.asDict() for r in m.projects().collect()])
    elif a.command == "link":
        out = dump(m.link(a.into, a.origin, a.query, a.k or 20))
    elif a.command == "export":
        out = dump(m.export(a.dest, a.project, a.graph, a.mindmap, a.as_context))
    elif a.command == "mindmap":
        out = sinks.write_text(a.out or "mindmap.html", m.mindmap(a.project))
    elif a.command == "compact":
        out = dump(m.compact(m.sole(a.project)))
    else:
        out = dump(m.status(a.ask))
    print(out)
    return out


if __name__ == "__main__":
    main()

"""python -m marlgrove QUERY DIR [--out PATH]: runs a registered query over the tables in DIR.

python -m marlgrove build DIR --out PATH [--mode MODE] [--force]: builds the corpus of the documents in DIR below PATH."""

from __future__ import annotations

import argparse

from .operators import driver
from .plans import registry
from .session import session
from .sources.tables import lines


def main(argv: list[str] | None = None) -> None:
    registry.load()
    parser = argparse.ArgumentParser(prog="marlgrove")
    parser.add_argument("query", choices=["build", *sorted(registry.QUERIES)])
    parser.add_argument("tables")
    parser.add_argument("--out", help="write parquet there in place of showing rows")
    parser.add_argument("--master")
    parser.add_argument("--mode", choices=driver.MODES, default="full")
    parser.add_argument("--force", action="store_true", help="build papers anew that are done")
    given = parser.parse_args(argv)
    if given.query == "build":
        if not given.out:
            parser.error("build needs --out")
        print(driver.run(lines(session(master=given.master), given.tables), given.out, given.mode, given.force))
        return
    df = registry.QUERIES[given.query](session(master=given.master), given.tables)
    if given.out:
        df.write.mode("overwrite").parquet(given.out)
    else:
        df.show(20, truncate=80)


if __name__ == "__main__":
    main()

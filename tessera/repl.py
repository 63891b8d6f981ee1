"""A shell: python -m tessera.repl ROOT [--demo]. One statement or command a line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .errors import EngineError
from .session import Engine, render

DEMO = (
    "CREATE TABLE users (id INT(16), name STRING(64), age INT(8))",
    "CREATE TABLE orders (id INT(16), user_id INT(16), amount INT(16))",
    "INSERT INTO users VALUES (1, 'Alice', 30), (2, 'Bob', 42), (3, 'Carol', 28), (4, 'Dave', 55)",
    "INSERT INTO orders VALUES (100, 1, 200), (101, 2, 300), (102, 3, 150), (103, 4, 500)",
    "CREATE INDEX idx_users_id ON users(id)",
)


def answer(engine: Engine, line: str) -> str:
    """What the shell prints for a line."""
    try:
        found = engine.execute(line)
    except EngineError as e:
        return f"error: {e}"
    except Exception as e:  # what Spark raises at run time ends the statement, not the shell
        return f"error: {str(e).splitlines()[0]}"
    return "\n".join(x for x in (render(found.df) if found.df is not None else "", found.message) if x)


def size(text: str) -> int:
    """Bytes, as 4096, 64K, 32M or 1G."""
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:].lower())
    return int(text[:-1]) * unit if unit else int(text)


def session(block_size: int | None, memory: int | None) -> SparkSession:
    """The session of the shell. Memory is that of the driver and of each executor; a block is a row group of a file."""
    builder = SparkSession.builder.appName("tessera")
    if memory:
        for who in ("driver", "executor"):
            builder = builder.config(f"spark.{who}.memory", f"{max(512, memory >> 20)}m")
    if block_size:
        builder = builder.config("spark.hadoop.parquet.block.size", str(block_size))
    return builder.getOrCreate()


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("root")
    args.add_argument("--demo", action="store_true")
    args.add_argument("--block-size", type=size, help="bytes of a row group")
    args.add_argument("--memory", type=size, help="bytes of memory of the driver and of each executor; 512M at least")
    args.add_argument("--disk", type=size, help="bytes that the tables may use")
    given = args.parse_args()
    engine = Engine(session(given.block_size, given.memory), given.root, max_bytes=given.disk)
    if given.demo and not engine.state.tables:
        for line in DEMO:
            engine.execute(line)
    while True:
        try:
            line = input("> ").strip()
        except EOFError:
            break
        if line.lower().rstrip(";") in ("exit", "quit"):
            break
        if line:
            print(answer(engine, line))
    engine.close()


if __name__ == "__main__":
    main()

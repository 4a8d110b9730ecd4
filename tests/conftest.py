"""Fixtures: a local session, the small tables, and rough copies of them."""

from __future__ import annotations

import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sievemill.session import local_session  # noqa: E402

DATA = os.environ.get("SIEVEMILL_TESTDATA", "/root/testdata")
SMALL = f"{DATA}/sf0.001"
TABLES = "board_statuses boards common_words customer documents embeddings eval_items events jobs lineitem mix_targets nation orders part pay_units places region supplier sweep_jobs".split()
#: Names that operators use for their own columns.
CLASHING = "key no rank block t text_a n value node component part word token city2 at w opening organisation stale2 copies mix_source".split()


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "8")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _write(table: pa.Table, folder, name: str) -> None:
    pq.write_table(table, os.path.join(folder, f"{name}.parquet"))


@pytest.fixture(scope="session")
def empty_tables(tmp_path_factory):
    """Every table without rows."""
    out = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        _write(pq.read_table(f"{SMALL}/{name}.parquet").slice(0, 0), out, name)
    return str(out)


LONG = "lorem ipsum 12 " * 10_000 + "x" * 60_000


@pytest.fixture(scope="session")
def rough_tables(tmp_path_factory):
    """The small tables with null rows, rows of a key alone, empty and very long texts, every row of a
    table twice, and extra columns of clashing names. Keys that were added start with 'zz-' or are
    negative."""
    out = tmp_path_factory.mktemp("rough")
    keys = {"jobs": "id", "sweep_jobs": "id", "documents": "doc_id", "boards": "boardkey"}
    for name in TABLES:
        table = pq.read_table(f"{SMALL}/{name}.parquet")
        if name in keys:
            rows = []
            for i, text in enumerate((None, "", " ", LONG)):
                row = {f.name: (text if pa.types.is_string(f.type) or pa.types.is_large_string(f.type) else None) for f in table.schema}
                row[keys[name]] = f"zz-{i}" if pa.types.is_string(table.schema.field(keys[name]).type) or pa.types.is_large_string(table.schema.field(keys[name]).type) else -1 - i
                rows.append(row)
            rows.append(dict.fromkeys(table.schema.names))
            table = pa.concat_tables([table, table, pa.Table.from_pylist(rows, schema=table.schema)])
            for c in CLASHING:
                if c not in table.schema.names:
                    table = table.append_column(c, pa.array([c] * table.num_rows))
        _write(table, out, name)
    return str(out)

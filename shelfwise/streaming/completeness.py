"""Completeness of games as files arrive: a game comes out once, in the batch in which its last file is found."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.matching import GAME, key_rows

#: Games that share a state.
RANGE = 256


def complete_as_seen(scans: DataFrame, roms: DataFrame, sha256_first: bool = False) -> DataFrame:
    """dat_ord, game_ord of games all of whose files have been seen: a stream of scan rows (archive_type, path, unheadered_size, crc,
    md5, sha1, sha256) against the catalog's files (rom_rows).

    A file counts once any of its keys has been seen, so the games so far are those that `complete_games` finds in all rows so
    far. Games whose numbers are next to each other share a state of a few KB, worked on as arrays: the files seen of games that
    lack some, and the games that came out. Copies of a file are dropped before the shuffle where they meet and change nothing;
    games without files never come out. Rows of failed scans have no keys and match nothing.
    """
    mine = key_rows(roms, [*GAME, "rom_ord", "n_roms"], sha256_first)
    seen = key_rows(scans.withColumnRenamed("size", "_size").withColumnRenamed("unheadered_size", "size"), [], sha256_first)
    kinds = {f.name: f.dataType.simpleString() for f in roms.schema}
    dat, game = GAME

    def distinct(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.drop_duplicates()

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = [np.frombuffer(bytes.fromhex(x), "<i8") for x in state.get] if state.exists else [np.zeros(0, "<i8")] * 2
        done, needed = np.zeros(RANGE, bool), np.full(RANGE, -1)
        done[old[1]] = True
        found = [old[0]]
        for pdf in frames:
            at = pdf[game].to_numpy("i8") - key[1] * RANGE
            needed[at] = pdf["n_roms"].to_numpy("i8")
            found.append(np.unique((at << 32 | pdf["rom_ord"].to_numpy("i8"))[~done[at]]))
        found = np.unique(np.concatenate(found))
        new = (np.bincount(found >> 32, minlength=RANGE) == needed) & ~done  # needed is known of the games of this batch
        done |= new
        state.update((found[~done[found >> 32]].astype("<i8").tobytes().hex(), np.flatnonzero(done).astype("<i8").tobytes().hex()))
        if new.any():
            yield pd.DataFrame({dat: key[0], game: np.flatnonzero(new) + key[1] * RANGE})

    rows = seen.join(mine, ["level", "key"]).select(*GAME, "rom_ord", "n_roms")
    rows = rows.mapInPandas(distinct, rows.schema).withColumn("_range", F.floor(F.col(game) / RANGE))
    return rows.groupBy(dat, "_range").applyInPandasWithState(update, ", ".join(f"{c} {kinds[c]}" for c in GAME), "seen string, done string", "append", GroupStateTimeout.NoTimeout)

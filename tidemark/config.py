"""Settings of a store."""

from __future__ import annotations

from dataclasses import dataclass

#: Caps that every write is held to, in bytes.
MAX_KEY_BYTES = 10_240
MAX_VALUE_BYTES = 1 << 20
#: Largest frame that recovery accepts.
MAX_FRAME_BYTES = 10 << 20


@dataclass(frozen=True)
class StoreConfig:
    """Folders, thresholds and level geometry; ``validate`` rejects what cannot work.

    ``truncate_log`` deletes a log batch once a run has its rows; without it (the default) batches stay for readers of
    older versions until ``KVStore.vacuum``. Folders with a scheme, such as hdfs://, may be on any file system that Spark
    reads. A batch is durable when its write returns, so there is no setting for syncing; Parquet pages are the blocks of
    a run, ``block_bytes`` their size.
    """

    data_dir: str = "./data/kv-data"
    log_dir: str = "./data/kv-log"
    memtable_bytes: int = 2 << 20
    block_bytes: int = 4096
    bloom_fpp: float = 0.01
    cache_shards: int = 16
    truncate_log: bool = False
    max_level: int = 7
    level_multiplier: int = 10
    level0_runs: int = 4
    level1_bytes: int = 10 << 20

    def validate(self) -> StoreConfig:
        if not self.data_dir or not self.log_dir:
            raise ValueError("folders must be named")
        if not 0 < self.bloom_fpp < 1:
            raise ValueError("bloom_fpp must lie between 0 and 1")
        if self.cache_shards < 1 or self.cache_shards & (self.cache_shards - 1):
            raise ValueError("cache_shards must be a power of two")
        if min(self.memtable_bytes, self.block_bytes, self.level0_runs, self.level1_bytes) < 1:
            raise ValueError("sizes and counts must be positive")
        if self.max_level < 2 or self.level_multiplier < 2:
            raise ValueError("there must be two levels at least, each larger than the one before")
        return self

    def level_limit(self, level: int) -> int:
        """Bytes from which a level is too large; level 0 is bounded by its number of runs instead."""
        return (1 << 63) - 1 if level == 0 else self.level1_bytes * self.level_multiplier ** (level - 1)

"""Settings of a store."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20


@dataclass(frozen=True)
class Options:
    """Sizes are in bytes.  The defaults suit a cluster; ``small()`` suits tests."""

    memtable_size: int = 256 * MIB
    sstable_size: int = 256 * MIB
    bloom_false_positive: float = 0.01
    base_level_size: int = 1 << 30
    level_size_multiplier: int = 10
    base_table_size: int = 256 * MIB
    table_size_multiplier: int = 2
    num_compactors: int = 3
    num_level_zero_tables: int = 15
    max_level_num: int = 7
    l0_merge_age_s: int = 10
    l0_merge_tables: int = 4
    keep_versions: int = 10

    @staticmethod
    def small() -> Options:
        """For tests: fixed values, all small."""
        return Options(memtable_size=1024, sstable_size=1024, base_level_size=10 * MIB, base_table_size=2 * MIB, bloom_false_positive=0.0)

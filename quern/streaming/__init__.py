"""Stateful event processing. Token buckets, deduplication, reaction counts, sessions and presence are batch operators and streams with the same result; replay, eviction and echo filters are batch operators."""

"""Errors of the sharding rules."""


class ShardingError(ValueError):
    """A value or a configuration that a sharding rule rejects."""


class MissingShardingKey(ShardingError):
    """The statement names no value of the sharding key."""


class InvalidKey(ShardingError):
    """The value of the sharding key has a type the rule cannot place."""


class DifferentSuffix(ShardingError):
    """The rows of one INSERT belong to different table shards (strict mode)."""

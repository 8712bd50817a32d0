"""Quality analytics on measured objects and service logs, expressed as Spark plans."""

from sievekit.session import checkpointed, tune

__all__ = ["checkpointed", "tune"]

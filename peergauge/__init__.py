"""Compare entities by the outcomes of their cases, each only with peers of its own category."""

from peergauge.spec import CaseSpec

__all__ = ["CaseSpec"]

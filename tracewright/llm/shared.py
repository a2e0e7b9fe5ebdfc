"""Session helpers of the subpackage."""

from ..operators.tables import materialise, release, shared_dir

__all__ = ["materialise", "release", "shared_dir"]

"""Imports every query module so that the registry is complete."""

from . import q_fingerprint  # noqa: F401
from . import q_profile  # noqa: F401
from . import q_clusters  # noqa: F401
from . import q_serving  # noqa: F401
from . import q_scoring  # noqa: F401
from . import q_models  # noqa: F401
from . import q_model_checks  # noqa: F401
from . import q_sources  # noqa: F401
from . import q_assignments  # noqa: F401
from . import q_publish  # noqa: F401
from . import q_run  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

"""Queries registered with the driver, each with the SQL that checks it."""

from . import answering, cleaning, profiles, reporting, wording  # noqa: F401
from .registry import RUN, SQL  # noqa: F401

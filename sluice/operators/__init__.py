"""The operators of flows; importing this package registers them."""

from . import columns, endpoints, joins, rows  # noqa: F401

"""Column functions over text of extracted documents under their short names."""

from __future__ import annotations

from ..operators.fields import page_list
from ..operators.tables import header_form as header_key
from .strings import sha12 as short_hash

__all__ = ["header_key", "page_list", "short_hash"]

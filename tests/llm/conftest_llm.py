"""What the tests of this folder share by import."""

import importlib.util
import os

_spec = importlib.util.spec_from_file_location("llm_conftest", os.path.join(os.path.dirname(__file__), "conftest.py"))
_own = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_own)
LOWER, SF, SPACED, odd_rows, ordered = _own.LOWER, _own.SF, _own.SPACED, _own.odd_rows, _own.ordered

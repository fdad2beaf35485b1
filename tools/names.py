"""Print the query names a plans module registers: python tools/names.py module ..."""
import importlib, os, sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from larkspur.plans import registry
for m in sys.argv[1:]:
    importlib.import_module(f"larkspur.plans.{m}")
print(" ".join(registry.QUERIES))

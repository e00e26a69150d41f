"""strataloom: repository analytics and training-data operators as Spark plans.

The core (sources, functions, operators, plans, streaming) never imports the
``llm`` subpackage; ``llm`` builds on the core.
"""

__version__ = "0.1.0"

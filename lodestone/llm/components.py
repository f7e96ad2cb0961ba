"""Connected components, as the near-duplicates use them."""

from ..operators.components import CHUNK, connected_components, forest  # noqa: F401

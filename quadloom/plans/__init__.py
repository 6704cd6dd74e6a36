"""The path algebra and its lowering."""

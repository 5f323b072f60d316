"""The surveyed engine has no streaming operator, so none is defined here; the batch operators take any DataFrame."""

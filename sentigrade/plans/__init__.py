"""The four end-to-end flows."""

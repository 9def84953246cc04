"""The store and its operators."""

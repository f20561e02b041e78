"""Composable operators: checked broadcast joins, top-N, first-per-group."""

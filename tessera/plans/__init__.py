"""From text to a bound plan: tokens, syntax tree, rendering, binding."""

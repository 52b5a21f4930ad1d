"""The user-facing jobs, composed of the operators."""

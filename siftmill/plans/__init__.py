"""Read models and registered queries."""

"""streaming of demesne."""

"""sources of demesne."""

"""operators of demesne."""

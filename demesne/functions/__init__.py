"""functions of demesne."""

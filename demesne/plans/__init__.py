"""plans of demesne."""
